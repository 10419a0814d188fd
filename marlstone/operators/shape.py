"""Reshaping: melting, ordering and flattening of rows and nested values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """A row (feature, value) for each named value."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), v.alias("value")) for n, v in values.items()])).alias("s")).select(*keys, "s.*")


def top_magnitudes(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], k: int) -> DataFrame:
    """The k values of each row that are largest by magnitude, ties by name."""
    ranked = F.array_sort(F.array(*[F.struct((-F.abs(v)).alias("d"), F.lit(n).alias("feature"), v.alias("value")) for n, v in values.items()]))
    out = df.select(*keys, F.posexplode(F.slice(ranked, 1, k)).alias("i", "s"))
    return out.select(*keys, "s.feature", "s.value", (F.col("i") + 1).cast("long").alias("place"))


def ordered_columns(df: DataFrame, preferred: Sequence[str], pinned: Sequence[str] = ()) -> DataFrame:
    """Pinned columns, then those of the preferred list (`prefix*` takes all that start so), then the rest by folded name."""
    left, order = list(df.columns), []
    for p in [*pinned, *preferred]:
        hits = [c for c in left if c.startswith(p[:-1])] if p.endswith("*") else [c for c in left if c == p]
        order += hits
        left = [c for c in left if c not in hits]
    return df.select(*[F.col(f"`{c}`") for c in order + sorted(left, key=str.casefold)])
