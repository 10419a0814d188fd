"""Ranks, running sums and exact quantiles of whole columns or groups without a task that holds one.

Different values are counted with partial sums, the counts are dealt by ranges (tables.in_order), and only the
sums of the ranges are added up in order. So a task holds a range, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch, in_order


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys of the same names in which null equals null."""
    if not keys:
        return left.crossJoin(right)  # right: one row
    named = right.select(*[F.col(k).alias(f"__j_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__j_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"__j_{k}" for k in keys])


def _group(by: Sequence[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], amount: str, scratch: Scratch, name: str) -> DataFrame:
    """df with `__before` (sum of `amount` over the rows of the group that come first), `__sum` (the group's) and
    `__pos` (rows before)."""
    rows = in_order(df, [*by, *order], scratch, name)
    per = rows.groupBy("__slot", *by).agg(F.sum(amount).alias("__s"), F.count(F.lit(1)).alias("__n"), F.min("__slot_at").alias("__first"))
    earlier = _group(by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"__start": F.coalesce(F.sum("__s").over(earlier), F.lit(0)), "__rows": F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first"), "__sum": F.sum("__s").over(_group(by))})
    rows = join_null_safe(rows, per.drop("__s", "__n", "__first"), ["__slot", *by])
    inside = F.sum(amount).over(Window.partitionBy("__slot", *by).orderBy("__slot_at").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"__before": F.col("__start") + F.coalesce(inside, F.lit(0)), "__pos": F.col("__rows") + F.col("__slot_at")})
    return rows.drop("__slot", "__slot_at", "__start", "__rows")


def value_line(df: DataFrame, by: Sequence[str], value: str, scratch: Scratch, name: str) -> DataFrame:
    """(by, value, n, before, total): different values in order, how many rows each has, how many come before it, and
    how many the group has. Null values are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, by, [value], "n", scratch, name).select(*by, value, "n", F.col("__before").alias("before"), F.col("__sum").alias("total"))


def average_ranks(df: DataFrame, by: Sequence[str], value: str, scratch: Scratch, name: str, rank: str = "rank") -> DataFrame:
    """(by, value, rank): ranks from 1 within the group; equal values share the mean of theirs. `<rank>_of`: the group's rows."""
    line = value_line(df, by, value, scratch, name)
    return line.select(*by, value, (F.col("before") + (F.col("n") + 1) / 2).alias(rank), F.col("total").alias(f"{rank}_of"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], scratch: Scratch | None = None, name: str = "quantiles") -> DataFrame:
    """(by, q): an array of exact quantiles, interpolated linearly, in the order of `probabilities`."""
    line = value_line(df, by, value, scratch or Scratch(df.sparkSession), name)
    ends = []
    for p in probabilities:
        at = F.lit(float(p)) * (F.col("total") - 1)
        inside = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
        ends += [F.max(F.when(inside(F.floor(at)), F.col(value).cast("double"))), F.max(F.when(inside(F.ceil(at)), F.col(value).cast("double")))]
    found = line.groupBy(*by).agg(F.max("total").alias("total"), *[e.alias(f"__e{i}") for i, e in enumerate(ends)])
    out = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.col(f"__e{2 * i}"), F.col(f"__e{2 * i + 1}")
        out.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    return found.select(*by, F.array(*out).alias("q"))
