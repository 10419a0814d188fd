"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Definition. A document's size is its number of words (null text: 0). Sources are sorted by code point, null
last; the weights are dealt to them in turn. Together the sources get `share` times all sizes. A source gets
its weight's part, but at most `cap` times its own size; what is above goes to the others by weight, until
none is above. Every document of a source then expects target / source_size copies. Documents are lined up
by (size, hash of seed and doc_id); the expected copies are summed up along the line, one offset per source
(from the seed) is added, and a document is emitted once for each integer that its stretch crosses. As equal
sizes stand together, a source's words miss its target by about one long document at most.

Positions come from a range-dealt table (operators/tables.py): no task holds a source or a size.

Edge cases. Very long texts are counted whole and move as a row. Null text, or text of white space: size 0, taken 0. Null source: a source of its own, the last.
Null or repeated doc_id: every row is a document; equal rows may swap places, which changes no result.
A source of size 0: target 0. Empty table: no rows. Other columns are ignored by `mix` and kept by `resample`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, group_key, hash60, own_columns, parts_for, ranked

WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per source of sizes(__key, __size): __source_size and __target.

    The table has a row per source, so the windows over all of it stay small. A source is above its cap
    just when it would be in the state where all with a lower cap per weight have been cut already.
    """
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy("__key")) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.groupBy("__key").agg(F.sum("__size").alias("__source_size")).withColumn("__w", w.cast("long"))
    s = s.withColumn("__cap", F.col("__source_size") * cap).withColumn("__all", F.sum("__source_size").over(Window.partitionBy()) * F.lit(float(share)))
    line = Window.orderBy(F.col("__cap") / F.col("__w"), "__key")
    before = F.coalesce(F.sum("__cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("__w").over(line.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("__cut", (F.col("__all") - before) * F.col("__w") >= (F.col("__cap") * rest).cast("double"))
    everywhere = Window.partitionBy()
    left = F.col("__all") - F.coalesce(F.sum(F.when(F.col("__cut"), F.col("__cap"))).over(everywhere), F.lit(0))
    uncut = F.sum(F.when(~F.col("__cut"), F.col("__w"))).over(everywhere)
    target = F.when(F.col("__cut"), F.col("__cap").cast("double")).otherwise(F.col("__w") * left / uncut)
    return s.select("__key", "__source_size", target.alias("__target"))


def _copies(sized: DataFrame, scratch: Scratch, parts: int, seed: str, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """sized(__id, __key, __size, __h, ...) with __source_size, __target and __copies."""
    per_source = lambda rows: targets(rows.select("__key", "__size"), weights, share, cap)
    mixed = ranked(sized, ["__key"], ["__size", "__h", "__id"], "__pos", "__n", scratch, "line", per_source, parts)
    each = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("__key"))), 1, 4), 16, 10).cast("double") / 65536.0
    mixed = mixed.withColumn("__each", each).withColumn("__u", offset)
    upto = F.floor((F.col("__pos") + 1) * F.col("__each") + F.col("__u"))
    crossed = upto - F.floor(F.col("__pos") * F.col("__each") + F.col("__u"))
    return mixed.withColumn("__copies", F.least(crossed, F.ceil("__each")).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words)."""
    scratch = Scratch(docs.sparkSession)
    sized = docs.select(F.col(id_col).alias("__id"), group_key(F.col(source_col)).alias("__key"), words(F.col(text_col)).alias("__size"))
    sized = scratch.table(sized.withColumn("__h", hash60(seed, F.col("__id"))), "sizes")
    out = _copies(sized, scratch, parts_for(sized.count(), 1 << 18), seed, weights, share, cap)
    return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def resample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """The mix itself: each row of docs as often as it is emitted, with all its columns. Rows cross one shuffle."""
    scratch = Scratch(docs.sparkSession)
    sized = docs.select(own_columns(docs).alias("__row"), F.col(id_col).alias("__id"), group_key(F.col(source_col)).alias("__key"), words(F.col(text_col)).alias("__size"))
    sized = sized.withColumn("__h", hash60(seed, F.col("__id")))
    out = _copies(sized, scratch, parts_for(docs.count(), 1 << 13), seed, weights, share, cap).where("__copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__i")).select("__row.*")
