"""Window-style operators: ranks, gaps and islands, diverse selection, unanimous fills, bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import join_null_safe, quantiles


def average_rank(c: str, by: Sequence[str] = ()) -> Column:
    """Ranks from 1; equal values share the mean of theirs. For small groups: a task sorts a group (see ranks.average_ranks)."""
    return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2


def first_occurrence(keys: Sequence[str], order: Sequence[Column | str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1


def diverse_top(df: DataFrame, by: Sequence[str], family: str, score: str, tie: str, k: int, per_family: int = 2) -> DataFrame:
    """k rows per group: in score order at most `per_family` of a family, then the passed-over ones in score order.

    A group of k rows or fewer keeps its plain order. Blank families are one, `unclassified`.
    """
    kind = F.coalesce(F.nullif(F.trim(family), F.lit("")), F.lit("unclassified"))
    order = [F.desc(score), F.asc(tie)]
    own = df.withColumn("__family", kind)
    own = own.withColumns({"__in": F.row_number().over(Window.partitionBy(*by, "__family").orderBy(*order)), "__all": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    late = (F.col("__all") > k) & (F.col("__in") > per_family)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(late, *order)).cast("long")
    return own.withColumn("place", place).where(F.col("place") <= k).drop("__family", "__in", "__all")


def gap_to_top(score: str, by: Sequence[str], margin: float) -> Column:
    """Whether the score is within the margin of the group's best."""
    return F.max(score).over(Window.partitionBy(*by)) - F.col(score) <= margin


def last_time_label(time: str, by: Sequence[str]) -> Column:
    """single, last, intermediate or unclear (no time), by the group's times rounded to 12 places."""
    w, t = Window.partitionBy(*by), F.round(F.col(time), 12)
    top, low = F.max(t).over(w), F.min(t).over(w)
    return F.when(t.isNull(), "unclear").when(top == low, "single").when(F.abs(top - t) <= 1e-9, "last").otherwise("intermediate")


def merge_short_runs(df: DataFrame, by: Sequence[str], order: str, section: str, text: str, least: int = 50) -> DataFrame:
    """Adjacent short texts (fewer words than `least`) of one section are joined; a long text stands alone."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("__short", F.size(F.filter(F.split(F.col(text), r"\s+"), lambda x: x != "")) < least)
    start = ~F.col("__short") | ~F.coalesce(F.lag("__short").over(w), F.lit(False)) | ~F.lag(section).over(w).eqNullSafe(F.col(section))
    rows = rows.withColumn("run", F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    kept = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*by, "run", section).agg(F.array_join(F.transform(kept, lambda s: s.t), "\n\n").alias(text), F.count(F.lit(1)).alias("pieces"))


def borrow_unanimous(df: DataFrame, column: str, scopes: Sequence[Sequence[str]]) -> DataFrame:
    """Missing cells take the one value that the narrowest scope with evidence agrees on; `<column>_from` is its number.

    A scope with several values stops the search: wider evidence can't settle a near conflict.
    """
    c, out, found, source = F.col(column), df, F.lit(None), F.lit(None).cast("int")
    stopped = F.lit(False)
    for i, keys in enumerate(scopes):
        seen = df.where(c.isNotNull()).groupBy(*keys).agg(F.min(column).alias(f"__lo{i}"), F.max(column).alias(f"__hi{i}"))
        out = out.join(seen, list(keys), "left")
    for i in range(len(scopes)):
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        take = ~stopped & lo.isNotNull() & (lo == hi)
        found, source = F.when(take, lo).otherwise(found), F.when(take, i).otherwise(source)
        stopped = stopped | lo.isNotNull()
    out = out.withColumn(f"{column}_from", F.when(c.isNull(), source)).withColumn(column, F.coalesce(c, found))
    return out.drop(*[f"__{x}{i}" for i in range(len(scopes)) for x in ("lo", "hi")])


def batches(items: Column, budget: int) -> Column:
    """Batch numbers of sizes in order: a new batch opens when the running total would pass the budget."""
    step = lambda s, n: F.when((s["t"] > 0) & (s["t"] + n > budget), F.struct((s["b"] + 1).alias("b"), n.alias("t"), F.array_append(s["out"], s["b"] + 1).alias("out"))).otherwise(F.struct(s["b"].alias("b"), (s["t"] + n).alias("t"), F.array_append(s["out"], s["b"]).alias("out")))
    zero = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("t"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(items, zero, step, lambda s: s["out"])


def quantile_bins(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds `bin` (from 0): edges at linear quantiles, equal ones dropped, right-closed, the lowest value included."""
    marks = [i / bins for i in range(bins + 1)]
    if by:
        edges = df.groupBy(*by).agg(F.array_distinct(F.percentile(value, F.array(*map(F.lit, marks)))).alias("__edges"))
    else:  # a whole column's quantiles: no task holds all its values
        edges = quantiles(df, by, value, marks).select(F.array_distinct("q").alias("__edges"))
    rows = join_null_safe(df, edges, by)
    above = F.size(F.filter("__edges", lambda e: e < F.col(value)))
    return rows.withColumn("bin", F.when(F.col(value).isNotNull(), F.greatest(above - 1, F.lit(0)))).drop("__edges")
