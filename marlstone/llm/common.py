"""What the corpus operators share: text conventions, keys and hashes. Tables and ranks are the library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import Scratch, ranked

__all__ = ["WORD", "Scratch", "group_key", "hash60", "own_columns", "parts_for", "ranked"]

#: Words are maximal runs without these bytes (the white space that bytes.split() also knows).
WORD = r"[^\x20\x09-\x0D]+"


def group_key(c: Column) -> Column:
    """A string column as a key without null: null, '' and 'null' stay apart; sorts by code point, null last."""
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c.cast("string")))


def hash60(*parts: Column | str) -> Column:
    """Sixty bits of the MD5 of the parts' text, joined by '|' (null: 'null'); the same in any SQL engine."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def own_columns(df: DataFrame) -> Column:
    """All columns of df as one struct, so that none can clash with a column that an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def parts_for(rows: int, each: int) -> int:
    return max(1, -(-rows // each))
