"""Aggregations: coalescing dedupe, classification and regression metrics, entity-weighted statistics.

Medians and quantiles are exact and interpolate linearly. Standard deviations divide by n - 1 and are 0 for one
value, unless said otherwise. All sums are algebraic, so partial aggregation applies throughout.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import blank_to_null
from .ranks import average_ranks, join_null_safe, quantiles, running
from .tables import Scratch


def median(c: Column | str) -> Column:
    return F.percentile(c, F.lit(0.5))


def first_filled(c: str, order: Column) -> Column:
    """The first non-blank value in order."""
    v = F.col(c)
    return F.min_by(v, F.when(blank_to_null(v).isNotNull(), order))


def joined(c: Column, order: Column, separator: str = "; ") -> Column:
    """Different values in the order in which they first occur."""
    kept = F.array_sort(F.collect_list(F.when(blank_to_null(c).isNotNull(), F.struct(order.alias("o"), c.cast("string").alias("v")))))
    return F.array_join(F.array_distinct(F.transform(kept, lambda s: s.v)), separator)


def coalesce_rows(df: DataFrame, key: str, order: Sequence[str], first: Sequence[str] = (), union: Mapping[str, str] | None = None, sticky: Sequence[str] = ()) -> DataFrame:
    """One row per key: first non-blank of `first` in order, set unions of `union` (column: separator), OR of `sticky`.

    Rows without a key stay as they are. `merged` counts the rows behind each.
    """
    at = F.struct(*order)
    keyed, bare = df.where(blank_to_null(F.col(key)).isNotNull()), df.where(blank_to_null(F.col(key)).isNull())
    aggregates = [first_filled(c, at).alias(c) for c in first] + [joined(F.col(c), at, s).alias(c) for c, s in (union or {}).items()]
    aggregates += [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in sticky]
    out = keyed.groupBy(key).agg(*aggregates, F.count(F.lit(1)).alias("merged"))
    return out.unionByName(bare.select(*out.columns[:-1], F.lit(1).cast("long").alias("merged")))


def confusion(truth: Column, guess: Column) -> list[Column]:
    return [F.count_if(c).alias(n) for n, c in (("tp", truth & guess), ("fp", ~truth & guess), ("tn", ~truth & ~guess), ("fn", truth & ~guess))]


def precision_recall(tp: Column, fp: Column, fn: Column, zero_fill: bool = False) -> dict[str, Column]:
    """precision (0 where nothing is guessed), recall and F1 (null without support, or 0 on demand)."""
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.try_divide(tp, tp + fn)
    r = F.coalesce(r, F.lit(0.0)) if zero_fill else r
    return {"precision": p, "recall": r, "f1": F.when(r.isNotNull(), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))}


def equal_source_weights(df: DataFrame, source: str) -> DataFrame:
    """Adds `weight`: every source weighs the same in total, the mean weight is 1."""
    sizes = df.groupBy(source).agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__rows"), F.count(F.lit(1)).alias("__sources"))
    weights = sizes.crossJoin(total).select(F.col(source).alias("__s"), (F.col("__rows") / F.col("__sources") / F.col("__n")).alias("weight"))  # total: one row
    return df.join(weights, F.col(source).eqNullSafe(F.col("__s")), "left").drop("__s")


def centred(df: DataFrame, by: Sequence[str], columns: Sequence[str], w: str | None = None, ok: Column | None = None) -> DataFrame:
    """df with `__mean_<column>`, the group's weighted mean over the rows that count."""
    weight = F.lit(1.0) if w is None else F.col(w)
    weight = weight if ok is None else F.when(ok, weight)
    means = df.groupBy(*by).agg(*[F.try_divide(F.sum(weight * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), weight))).alias(f"__mean_{c}") for c in columns])
    return join_null_safe(df, means, by)


def regression_by(df: DataFrame, by: Sequence[str], y: str, guess: str, w: str | None = None) -> DataFrame:
    """(by, n, mae, rmse, r2): the metrics per group. The truth is centred first, so a large mean costs R2 no digits."""
    rows = centred(df, by, [y], w, F.col(y).isNotNull() & F.col(guess).isNotNull())
    found = regression(F.col(y), F.col(guess), None if w is None else F.col(w), F.col(f"__mean_{y}"))
    return rows.groupBy(*by).agg(*[v.alias(k) for k, v in found.items()])


def regression(y: Column, guess: Column, w: Column | None = None, mean_y: Column | None = None) -> dict[str, Column]:
    """Weighted n, MAE, RMSE and R2 (null for fewer than two rows or a constant truth), in one pass.

    mean_y: the group's mean, by which the spread is centred (regression_by adds it). Without it the spread is the
    built-in variance, and with weights that of squares less the mean's, which loses digits where means are large."""
    weighted, w = w is not None, F.lit(1.0) if w is None else w
    ok = y.isNotNull() & guess.isNotNull()
    total = F.sum(F.when(ok, w))
    mean = lambda c: F.try_divide(F.sum(F.when(ok, w * c)), total)
    mse = mean((y - guess) ** 2)
    spread = mean((y - mean_y) ** 2) if mean_y is not None else mean(y * y) - mean(y) ** 2 if weighted else F.var_pop(F.when(ok, y))
    n = F.count_if(ok)
    return {"n": n, "mae": mean(F.abs(y - guess)), "rmse": F.sqrt(mse), "r2": F.when((n > 1) & (F.count_distinct(F.when(ok, y)) > 1), 1 - F.try_divide(mse, spread))}


def weighted_correlation(x: Column, y: Column, w: Column) -> Column:
    """Pearson's with weights, of columns whose means are near 0 (centre them first: `centred`)."""
    s = F.sum(w)
    mx, my = F.sum(w * x) / s, F.sum(w * y) / s
    cov = F.sum(w * x * y) / s - mx * my
    return F.try_divide(cov, F.sqrt((F.sum(w * x * x) / s - mx * mx) * (F.sum(w * y * y) / s - my * my)))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's; null where a side does not vary (the built-in one fails then under ANSI rules)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, w: Column | None = None) -> DataFrame:
    """Rank correlation per group over complete pairs: average ranks, weighted Pearson of them, centred at the middle rank."""
    scratch = Scratch(df.sparkSession)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"), (F.lit(1.0) if w is None else w).alias("__w"))
    pairs = scratch.table(pairs, "pairs")
    rows = pairs
    for c in ("__x", "__y"):
        rows = join_null_safe(rows, average_ranks(pairs, by, c, scratch, f"line{c}", f"{c}r"), [*by, c])
    middle = lambda c: F.col(f"{c}r") - (F.col(f"{c}r_of") + 1) / 2
    varied = (F.min("__x") < F.max("__x")) & (F.min("__y") < F.max("__y"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(varied, weighted_correlation(middle("__x"), middle("__y"), F.col("__w"))).alias("spearman"))


def distribution(c: Column) -> dict[str, Column]:
    n = F.count(c)
    sd = F.when(n > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0)))
    sem = sd / F.sqrt(n)
    return {"n": n, "mean": F.avg(c), "median": median(c), "sd": sd, "sem": sem, "low": F.avg(c) - 1.96 * sem, "high": F.avg(c) + 1.96 * sem, "min": F.min(c), "max": F.max(c)}


def nested_median(df: DataFrame, by: Sequence[str], study: str, value: str, exact: str | None = None) -> DataFrame:
    """Median within each study, then across studies; where a group has exact rows, only these count."""
    if exact:
        has = df.groupBy(*by).agg(F.bool_or(F.coalesce(F.col(exact), F.lit(False))).alias("__has"))
        df = df.join(has, list(by)).where(~F.col("__has") | F.coalesce(F.col(exact), F.lit(False)))
    inner = df.groupBy(*by, study).agg(median(value).alias("__m"), F.count(F.lit(1)).alias("__n"))
    return inner.groupBy(*by).agg(median("__m").alias("score"), F.count(F.lit(1)).alias("studies"), F.sum("__n").alias("rows"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: missing rate, distinct values, the most common one and its share, quantiles, spread."""
    scratch, marks = Scratch(df.sparkSession), (0.05, 0.5, 0.95, 0.25, 0.75)
    tall = scratch.table(df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*"), "tall")
    whole = tall.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("v").isNull().cast("double")).alias("missing"), F.stddev_samp("v").alias("sd"))
    counts = tall.where("v is not null").groupBy("feature", "v").agg(F.count(F.lit(1)).alias("k"))
    mode = counts.groupBy("feature").agg(F.min_by("v", F.struct(-F.col("k"), F.col("v"))).alias("mode"), F.max("k").alias("top"), F.sum("k").alias("there"), F.count(F.lit(1)).alias("distinct"))
    q = quantiles(tall, ["feature"], "v", marks, scratch).select("feature", *[F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p50", "p95", "__q1", "__q3"))])
    out = whole.join(mode, "feature", "left").join(q, "feature", "left").withColumns({"mode_share": F.try_divide("top", "there"), "distinct": F.coalesce("distinct", F.lit(0).cast("long")), "iqr": F.col("__q3") - F.col("__q1")})
    return out.select("feature", "n", "missing", "distinct", "p05", "p50", "p95", "sd", "iqr", "mode", "mode_share")


def pair_correlations(df: DataFrame, row: str, columns: Sequence[str], least: int = 3) -> DataFrame:
    """Pearson and Spearman of each pair of columns over the rows where both are there; ranks are taken per pair.

    The pairs are of columns, so their number does not depend on the rows.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])).alias("s")).select("s.*").where("x is not null and y is not null")
    s = spearman(tall, ["a", "b"], "x", "y").drop("n")
    varied = (F.count(F.lit(1)) >= least) & (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    return tall.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.when(varied, correlation("x", "y")).alias("pearson")).join(s, ["a", "b"])


def unit_distribution(df: DataFrame, unit: str, value: str) -> DataFrame:
    """Each unit has mass 1, spread over its rows; per value the mean mass."""
    rows = df.where(F.col(value).isNotNull())
    each = rows.groupBy(unit, value).agg(F.count(F.lit(1)).alias("__k")).withColumn("__p", F.col("__k") / F.sum("__k").over(Window.partitionBy(unit)))
    units = rows.agg(F.count_distinct(unit).alias("__units"))
    return each.groupBy(value).agg(F.sum("__p").alias("mass")).crossJoin(units).select(value, (F.col("mass") / F.col("__units")).alias("share"))  # units: one row


def entropy(p: Column) -> Column:
    """Of shares, natural logarithm."""
    return -F.sum(F.when(p > 0, p * F.ln(F.when(p > 0, p))))


def consensus(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most common text (ties by folded text) and, if there are several, all of them in folded order."""
    counts = df.where(blank_to_null(F.col(value)).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__k"))
    folded = F.lower(value)
    return counts.groupBy(*by).agg(
        F.min_by(value, F.struct(-F.col("__k"), folded, F.col(value))).alias("consensus"),
        F.when(F.count(F.lit(1)) > 1, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(folded.alias("f"), F.col(value).alias("v")))), lambda s: s.v), " | ")).alias("conflict"),
    )


def variance_components(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way random effects by moments: within, between (0 at least) and their intraclass correlation."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    n, k = F.sum("n"), F.count(F.lit(1))
    within = F.try_divide(F.sum(F.coalesce(F.col("v"), F.lit(0.0)) * (F.col("n") - 1)), n - k)
    grand = F.sum(F.col("n") * F.col("m")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * grand * grand
    size = (n - F.sum(F.col("n") * F.col("n")) / n) / (k - 1)
    out = g.agg(k.alias("groups"), n.alias("rows"), within.alias("within"), F.greatest((between / (k - 1) - within) / size, F.lit(0.0)).alias("between"))
    return out.withColumn("icc", F.try_divide("between", F.col("between") + F.col("within")))


def histogram(df: DataFrame, value: str, most: int) -> DataFrame:
    """(bin, n): evenly spaced bins, the last one closed; their number by Freedman and Diaconis, at least 4 and at least
    the root of n where the rule gives fewer than 4. Missing values, and those of a column with one value, count in the
    last bin. The quartiles are taken by ranges, so no task holds the different values of the column."""
    v, (lo, hi, n, bins) = F.col(value), (F.col(f"__{x}") for x in ("lo", "hi", "n", "bins"))
    iqr = F.get("q", F.lit(1)) - F.get("q", F.lit(0))
    raw = F.coalesce(F.ceil(F.try_divide(hi - lo, 2 * iqr / F.pow(n, F.lit(1 / 3)))), F.lit(0))
    small = F.least(F.lit(most), F.greatest(F.lit(4), F.ceil(F.sqrt(n))))
    facts = df.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"), F.count(v).alias("__n")).crossJoin(quantiles(df, [], value, [0.25, 0.75]))
    facts = facts.withColumn("__bins", F.when(raw < 4, small).otherwise(F.least(raw, F.lit(most))).cast("long")).drop("q")
    at = F.least(F.floor((v - lo) * bins / F.nullif(hi - lo, F.lit(0.0))), bins - 1)
    return df.select(value).crossJoin(facts).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # facts: one row


def cumulative_share(df: DataFrame, value: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank by value, share and running share within `by`."""
    rows = running(df, by, [F.desc(value), F.asc(tie)], value, Scratch(df.sparkSession), "line")
    out = rows.withColumns({"place": (F.col("__pos") + 1).cast("long"), "share": F.col(value) / F.col("__sum"), "running": (F.col("__before") + F.col(value)) / F.col("__sum")})
    return out.select(*df.columns, "place", "share", "running")


def metrics_by_availability(df: DataFrame, features: Sequence[str], y: str, guess: str, weight: str | None = None) -> DataFrame:
    """(feature, present, n, mae, rmse, r2): the metrics where each feature is there and where it is not."""
    w = (F.col(weight) if weight else F.lit(1.0)).alias("__w")
    tall = df.select(y, guess, w, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).isNotNull().alias("present")) for f in features])).alias("s")).select(y, guess, "__w", "s.*")
    return regression_by(tall, ["feature", "present"], y, guess, "__w")


def stability(df: DataFrame, config: str, run: str, feature: str) -> DataFrame:
    """(config, feature, selected, runs, share): in how many of a configuration's runs a feature was selected."""
    runs = df.groupBy(config).agg(F.count_distinct(run).alias("runs"))
    each = df.groupBy(config, feature).agg(F.count_distinct(run).alias("selected"))
    return each.join(runs, config).withColumn("share", F.col("selected") / F.col("runs"))
