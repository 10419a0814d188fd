"""Aggregation operators on the driver's tables. Sums of floats are rounded, as their order differs by engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import audit as D
from ..operators import window as W
from .registry import Registry, table

plans = Registry()
query = plans.query


def _r(c, n: int = 6):
    return F.round(c, n)


def _rounded(df: DataFrame, names, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in names})


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped counts and sums over filtered rows; the filter and four columns reach the scan."""
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), _r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), _r(F.avg("l_discount")).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT trim(reason) AS reason, count(*) AS n FROM (SELECT unnest(string_split(CASE WHEN p_size > 25 THEN 'big; ' ELSE '' END || CASE WHEN p_retailprice > 1000 THEN 'dear;' ELSE '' END || lower(p_brand), ';')) AS reason FROM part) GROUP BY 1""")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of reasons from packed text."""
    packed = F.concat(F.when(F.col("p_size") > 25, "big; ").otherwise(""), F.when(F.col("p_retailprice") > 1000, "dear;").otherwise(""), F.lower("p_brand"))
    return table(spark, sf_dir, "part").select(F.explode(F.split(packed, ";")).alias("r")).groupBy(F.trim("r").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT k AS user_key, min_by(event_type, event_id) FILTER (WHERE event_type <> '') AS event_type, string_agg(DISTINCT source, ',' ORDER BY source) AS source, bool_or(flag) AS flag, count(*) AS merged
 FROM (SELECT user_id::VARCHAR AS k, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS event_type, event_id, event_type AS source, value > 90 AS flag FROM events WHERE user_id % 10 <> 0) GROUP BY k
 UNION ALL SELECT NULL, CASE WHEN event_type = 'view' THEN '' ELSE event_type END, event_type, coalesce(value > 90, false), 1 FROM events WHERE user_id % 10 = 0""".replace("bool_or(flag)", "coalesce(bool_or(flag), false)"))
def coalesce_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key with first non-blank values, set unions and sticky flags; rows without key kept (every tenth user has none)."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).alias("user_key"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("event_type"), "event_id", F.col("event_type").alias("source"), F.coalesce(F.col("value") > 90, F.lit(False)).alias("flag"))
    out = A.coalesce_rows(e, "user_key", ["event_id"], ["event_type"], {"source": ","}, ["flag"])
    return out.withColumn("source", F.array_join(F.array_sort(F.split("source", ",")), ","))


_LABELLED = "SELECT d.source, d.lang, quality = 1 AS truth, n_chars > 400 AS guess FROM documents d JOIN labels USING (doc_id)"


@query(f"""SELECT source, tp, fp, tn, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN r IS NOT NULL THEN coalesce(2 * p * r / nullif(p + r, 0), 0) END, 9) AS f1, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy
 FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, tp / nullif(tp + fn, 0) AS r FROM (SELECT source, count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (NOT truth AND NOT guess) AS tn, count(*) FILTER (truth AND NOT guess) AS fn FROM ({_LABELLED}) GROUP BY source))""")
def confusion_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and their rates; recall and F1 are null without support."""
    return _rounded(_confusion(spark, sf_dir, "source"), ["precision", "recall", "f1", "accuracy"], 9)


def _confusion(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    c = d.groupBy(*by).agg(*A.confusion(F.col("quality") == 1, F.col("n_chars") > 400))
    c = c.withColumns(A.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))
    return c.withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")))


@query(f"""WITH c AS (SELECT source, count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (truth AND NOT guess) AS fn FROM ({_LABELLED}) GROUP BY source),
 m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c), t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c)
 SELECT 'macro' AS kind, round(avg(p), 9) AS precision, round(avg(r), 9) AS recall FROM m UNION ALL SELECT 'macro zero-filled', round(avg(p), 9), round(avg(coalesce(r, 0)), 9) FROM m
 UNION ALL SELECT 'weighted', round(sum(p * greatest(tp + fn, 1)) / sum(greatest(tp + fn, 1)), 9), round(sum(coalesce(r, 0) * greatest(tp + fn, 1)) / sum(greatest(tp + fn, 1)), 9) FROM m
 UNION ALL SELECT 'micro', round(tp / (tp + fp), 9), round(tp / (tp + fn), 9) FROM t""")
def macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro means (undefined recall skipped, or zero), means weighted by support, micro rates."""
    c = _confusion(spark, sf_dir, "source")
    w = F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    r0 = F.coalesce("recall", F.lit(0.0))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    one = c.agg(F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("precision"), r.alias("recall")) for k, p, r in (
        ("macro", F.avg("precision"), F.avg("recall")), ("macro zero-filled", F.avg("precision"), F.avg(r0)),
        ("weighted", F.sum(F.col("precision") * w) / F.sum(w), F.sum(r0 * w) / F.sum(w)), ("micro", tp / (tp + fp), tp / (tp + fn)))]).alias("a"))
    return _rounded(one.select(F.explode("a").alias("s")).select("s.*"), ["precision", "recall"], 9)


@query(f"""SELECT source, lang, count(*) AS n, count(*) FILTER (truth AND guess) AS tp, grouping(source) AS g_source, grouping(lang) AS g_lang FROM ({_LABELLED}) GROUP BY GROUPING SETS ((source, lang), (lang), ())""")
def grouping_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a summary and the grand total in one pass."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = d.groupingSets([["source", "lang"], ["lang"], []], "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("quality") == 1) & (F.col("n_chars") > 400)).alias("tp"), F.grouping("source").cast("long").alias("g_source"), F.grouping("lang").cast("long").alias("g_lang"))
    return out.select("source", "lang", "n", "tp", "g_source", "g_lang")


@query("""WITH g AS (SELECT p_partkey, unnest(['brand', 'type']) AS field, unnest([p_brand, p_type]) AS v FROM part WHERE p_partkey % 7 <> 0),
 p AS (SELECT p_partkey, unnest(['brand', 'type']) AS field, unnest([p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'X' ELSE p_type END]) AS v FROM part WHERE p_partkey % 5 <> 0)
 SELECT field, tp, fp, fn, round(tp / (tp + fp + fn), 9) AS accuracy, round(tp / n_truth, 9) AS exact_rate FROM (SELECT field, count(*) FILTER (g.v = p.v) AS tp, count(*) FILTER (p.v IS NOT NULL AND g.v IS DISTINCT FROM p.v) AS fp,
 count(*) FILTER (g.v IS NOT NULL AND g.v IS DISTINCT FROM p.v) AS fn, count(g.v) AS n_truth FROM g FULL JOIN p USING (p_partkey, field) GROUP BY field)""")
def field_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field by field, a mismatch is a false positive and a false negative."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    tall = lambda d, kind, as_: d.select("p_partkey", F.explode(F.array(F.struct(F.lit("brand").alias("field"), F.col("p_brand").alias("v")), F.struct(F.lit("type").alias("field"), kind.alias("v")))).alias("s")).select("p_partkey", "s.field", F.col("s.v").alias(as_))
    g, p = tall(part.where(k % 7 != 0), F.col("p_type"), "g"), tall(part.where(k % 5 != 0), F.when(k % 3 == 0, "X").otherwise(F.col("p_type")), "p")
    same = F.col("g").eqNullSafe(F.col("p"))
    c = g.join(p, ["p_partkey", "field"], "full_outer").groupBy("field").agg(F.count_if(same).alias("tp"), F.count_if(F.col("p").isNotNull() & ~same).alias("fp"), F.count_if(F.col("g").isNotNull() & ~same).alias("fn"), F.count("g").alias("t"))
    return c.select("field", "tp", "fp", "fn", _r(F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn")), 9).alias("accuracy"), _r(F.col("tp") / F.col("t"), 9).alias("exact_rate"))


_PREDICTED = "SELECT l_orderkey, l_suppkey, l_returnflag, l_extendedprice / 1000 AS y, p_retailprice * l_quantity / 1000 AS g, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey"
_WEIGHTED = f"SELECT *, (count(*) OVER ()) / (SELECT count(DISTINCT l_orderkey) FROM lineitem) / count(*) OVER (PARTITION BY l_orderkey) AS w FROM ({_PREDICTED})"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return table(spark, sf_dir, "lineitem").join(p, "l_partkey").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("p_retailprice") * F.col("l_quantity") / 1000).alias("g"))


@query(f"""SELECT l_returnflag, count(*) AS n, round(sum(w * abs(y - g)) / sum(w), 6) AS mae, round(sqrt(sum(w * (y - g) ** 2) / sum(w)), 6) AS rmse,
 round(1 - (sum(w * (y - g) ** 2) / sum(w)) / (sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2), 6) AS r2 FROM ({_WEIGHTED}) GROUP BY 1""")
def weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression metrics with equal weight per source record."""
    p = A.equal_source_weights(_predicted(spark, sf_dir), "l_orderkey")
    return _rounded(A.regression_by(p, ["l_returnflag"], "y", "g", "weight").where("n >= 3"), ["mae", "rmse", "r2"])


@query(f"""WITH r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, y) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY g) + (count(*) OVER (PARTITION BY l_returnflag, g) - 1) / 2 AS ry FROM ({_PREDICTED}))
 SELECT l_returnflag, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation with average ranks per group."""
    return _rounded(A.spearman(_predicted(spark, sf_dir), ["l_returnflag"], "y", "g"), ["spearman"])


@query(f"""SELECT stratum, count(*) AS n, round(avg(abs(y - g)), 6) AS mae, round(avg(CASE WHEN abs(log10(y) - log10(g)) <= log10(2) THEN 1.0 ELSE 0 END), 6) AS factor_2
 FROM (SELECT *, CASE WHEN y < 20 THEN 'low' WHEN y > 50 THEN 'high' ELSE 'middle' END AS stratum FROM ({_PREDICTED})) GROUP BY 1""")
def stratified_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics below, between (inclusive) and above two thresholds, with factor-of-two accuracy."""
    p = _predicted(spark, sf_dir).withColumn("stratum", F.when(F.col("y") < 20, "low").when(F.col("y") > 50, "high").otherwise("middle"))
    near = F.abs(F.log10("y") - F.log10("g")) <= F.log10(F.lit(2.0))
    return p.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), _r(F.avg(F.abs(F.col("y") - F.col("g")))).alias("mae"), _r(F.avg(near.cast("double"))).alias("factor_2"))


@query(f"""WITH s AS (SELECT l_suppkey, l_orderkey, l_returnflag, avg(y - g) AS m FROM ({_PREDICTED}) GROUP BY ALL), t AS (SELECT l_suppkey, l_returnflag, avg(m) AS m FROM s GROUP BY ALL)
 SELECT l_suppkey, round(median(m), 6) AS residual, count(*) AS assignments FROM t GROUP BY 1""")
def two_stage_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: mean per source, then per group, then the median over assignments."""
    out = D.two_stage_residuals(_predicted(spark, sf_dir), ["l_suppkey"], "l_orderkey", "l_returnflag", F.col("y") - F.col("g"))
    return _rounded(out, ["residual"])


@query("""WITH h AS (SELECT l_partkey, bool_or(l_quantity > 45) AS has FROM lineitem GROUP BY 1), i AS (SELECT l_partkey, l_suppkey, quantile_cont(l_extendedprice, 0.5) AS m, count(*) AS n FROM lineitem JOIN h USING (l_partkey) WHERE NOT has OR l_quantity > 45 GROUP BY ALL)
 SELECT l_partkey, round(quantile_cont(m, 0.5), 4) AS score, count(*) AS studies, sum(n)::BIGINT AS rows FROM i GROUP BY 1""")
def study_balanced_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median within a study, then across; exact rows alone where there are any."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_quantity") > 45).alias("exact"))
    return _rounded(A.nested_median(l, ["l_partkey"], "l_suppkey", "l_extendedprice", "exact"), ["score"], 4)


@query("""SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median, round(stddev_samp(c_acctbal), 6) AS sd, round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS sem,
 round(avg(c_acctbal) - 1.96 * stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS low, round(avg(c_acctbal) + 1.96 * stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS high, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer GROUP BY 1""")
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, spread, interval."""
    d = A.distribution(F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(*[(v if k in ("n", "min", "max") else _r(v)).alias(k) for k, v in d.items()])


_TALL = "SELECT 'price' AS feature, p_retailprice AS v FROM part UNION ALL SELECT 'size', CASE WHEN p_size % 9 <> 0 THEN p_size END FROM part"


@query(f"""WITH t AS ({_TALL}), c AS (SELECT feature, v, count(*) AS k FROM t WHERE v IS NOT NULL GROUP BY ALL), m AS (SELECT feature, v AS mode, k / sum(k) OVER (PARTITION BY feature) AS share, row_number() OVER (PARTITION BY feature ORDER BY k DESC, v) AS r FROM c)
 SELECT feature, n, missing, "distinct", p05, p50, p95, sd, iqr, mode, round(share, 9) AS mode_share FROM (SELECT feature, count(*) AS n, round(avg((v IS NULL)::INT), 9) AS missing, count(DISTINCT v) AS "distinct", round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.5), 6) AS p50,
 round(quantile_cont(v, 0.95), 6) AS p95, round(stddev_samp(v), 6) AS sd, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr FROM t GROUP BY 1) JOIN m USING (feature) WHERE r = 1""")
def scalar_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of numeric columns."""
    p = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("price"), F.when(F.col("p_size") % 9 != 0, F.col("p_size")).alias("size"))
    return _rounded(_rounded(A.profile(p, ["price", "size"]), ["p05", "p50", "p95", "sd", "iqr"]), ["missing", "mode_share"], 9)


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {x} AS x, {y} AS y FROM lineitem WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for a, x, b, y in (("l_quantity", "l_quantity", "l_extendedprice", "l_extendedprice"), ("l_quantity", "l_quantity", "discount", "nullif(l_discount, 0)"), ("l_extendedprice", "l_extendedprice", "discount", "nullif(l_discount, 0)")))


@query(f"""WITH r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM ({_PAIRS}))
 SELECT a, b, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY ALL""")
def pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise correlations over complete pairs."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", F.nullif("l_discount", F.lit(0.0)).alias("discount"))
    return _rounded(A.pair_correlations(l, "l_orderkey", ["l_quantity", "l_extendedprice", "discount"]), ["pearson", "spearman"])


@query("""SELECT event_type, count(DISTINCT user_id) AS units, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 9) AS coverage, count(DISTINCT user_id) FILTER (value > 50) AS high_units FROM events GROUP BY 1""")
def entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that report, and their share of all."""
    out = D.unit_coverage(table(spark, sf_dir, "events"), ["event_type"], "user_id", {"high_units": F.col("value") > 50})
    return _rounded(out, ["coverage"], 9)


@query("""WITH k AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY 1, 2), p AS (SELECT *, k / sum(k) OVER (PARTITION BY user_id) AS p FROM k) SELECT event_type, round(sum(p) / (SELECT count(DISTINCT user_id) FROM events), 9) AS share FROM p GROUP BY 1""")
def unit_weighted_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit has mass 1."""
    return _rounded(A.unit_distribution(table(spark, sf_dir, "events"), "user_id", "event_type"), ["share"], 9)


@query("""WITH k AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY 1, 2), p AS (SELECT *, k / sum(k) OVER (PARTITION BY user_id) AS p FROM k), h AS (SELECT user_id, -sum(p * ln(p)) AS h, sum(k) AS k FROM p GROUP BY 1),
 t AS (SELECT event_type, sum(k) / (SELECT sum(k) FROM p) AS q FROM p GROUP BY 1) SELECT round(total, 9) AS total, round(within_h, 9) AS within_h, round(within_h / total, 9) AS within_share, round(total / ln(n), 9) AS normalised
 FROM (SELECT -sum(q * ln(q)) AS total, count(*) AS n FROM t), (SELECT sum(h * k) / sum(k) AS within_h FROM h)""")
def entropy_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy over all rows and within units."""
    k = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("k"))
    within = k.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy("user_id"))).groupBy("user_id").agg(A.entropy(F.col("p")).alias("h"), F.sum("k").alias("k"))
    within = within.agg((F.sum(F.col("h") * F.col("k")) / F.sum("k")).alias("within_h"))
    whole = k.groupBy("event_type").agg(F.sum("k").alias("k"))
    total = whole.crossJoin(whole.agg(F.sum("k").alias("n"))).select((F.col("k") / F.col("n")).alias("q")).agg(A.entropy(F.col("q")).alias("total"), F.count(F.lit(1)).alias("types"))
    both = total.crossJoin(within)  # one row each
    return both.select(_r("total", 9).alias("total"), _r("within_h", 9).alias("within_h"), _r(F.col("within_h") / F.col("total"), 9).alias("within_share"), _r(F.col("total") / F.ln("types"), 9).alias("normalised"))


@query("""WITH r AS (SELECT DISTINCT user_id, event_type FROM events), t AS (SELECT DISTINCT user_id, event_type FROM events WHERE value <= 40), m AS (SELECT event_type, count(*) AS k FROM events GROUP BY 1)
 SELECT round((SELECT count(DISTINCT user_id) FROM t) / (SELECT count(DISTINCT user_id) FROM r), 9) AS entities, round((SELECT sum(k) FROM m WHERE event_type IN (SELECT event_type FROM t)) / (SELECT sum(k) FROM m), 9) AS mass,
 round((SELECT count(*) FROM (SELECT user_id FROM t GROUP BY 1 HAVING count(*) > 1)) / (SELECT count(*) FROM (SELECT user_id FROM r GROUP BY 1 HAVING count(*) > 1)), 9) AS contrast""")
def reference_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, value mass and contrasting entities that a subset keeps of a reference."""
    e = table(spark, sf_dir, "events")
    return _rounded(D.retention(e, e.where("value <= 40"), "user_id", "event_type"), ["entities", "mass", "contrast"], 9)


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS m, coalesce(var_samp(l_quantity), 0) AS v FROM lineitem GROUP BY 1), s AS (SELECT count(*) AS k, sum(n) AS n, sum(v * (n - 1)) / (sum(n) - count(*)) AS w, sum(n * m) / sum(n) AS gm, sum(n * m * m) AS nm, sum(n * n) AS nn FROM g),
 b AS (SELECT *, greatest(((nm - n * gm * gm) / (k - 1) - w) / ((n - nn / n) / (k - 1)), 0) AS b FROM s) SELECT k AS groups, n::BIGINT AS rows, round(w, 6) AS "within", round(b, 5) AS "between", round(b / (b + w), 6) AS icc FROM b""")
def variance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within and between variance, intraclass correlation."""
    v = A.variance_components(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity")
    return _rounded(_rounded(v, ["within", "icc"]), ["between"], 5)


@query("""WITH k AS (SELECT p_brand, p_type, count(*) AS k FROM part GROUP BY ALL), c AS (SELECT p_brand, p_type AS consensus FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY k DESC, lower(p_type), p_type) AS r FROM k) WHERE r = 1)
 SELECT p_brand, (min(p_retailprice) + max(p_retailprice)) / 2 AS price, CASE WHEN min(p_retailprice) = max(p_retailprice) THEN min(p_retailprice)::VARCHAR ELSE min(p_retailprice)::VARCHAR || '-' || max(p_retailprice)::VARCHAR END AS price_range, count(DISTINCT p_retailprice) AS n_values, any_value(consensus) AS kind, (SELECT CASE WHEN count(*) > 1 THEN string_agg(p_type, ' | ' ORDER BY lower(p_type), p_type) END FROM k WHERE k.p_brand = part.p_brand) AS conflict
 FROM part JOIN c USING (p_brand) GROUP BY p_brand""")
def entity_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Midpoint and range of numbers, most common text and its conflicts."""
    c = D.consolidate(table(spark, sf_dir, "part"), "p_brand", ["p_retailprice"], ["p_type"])
    return c.select("p_brand", F.col("p_retailprice").alias("price"), F.col("p_retailprice_range").alias("price_range"), F.col("p_retailprice_n_values").alias("n_values"), F.col("p_type").alias("kind"), F.col("p_type_conflict").alias("conflict"))


@query("""SELECT user_id, max(value) AS top, min(value) AS low, concat_ws('; ', CASE WHEN max(value) > 95 THEN 'high value ' || printf('%.3f', max(value)) END, CASE WHEN min(value) < 5 THEN 'low value ' || printf('%.3f', min(value)) END) AS reason
 FROM events WHERE value > 95 OR value < 5 GROUP BY 1""")
def outlier_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows beyond the limits, one line per source record with the reason."""
    return D.review_queue(table(spark, sf_dir, "events"), "user_id", "value", 5, 95, strict=True)


@query(f"""WITH s AS (SELECT l_returnflag AS family, l_suppkey AS study, avg(abs(y - g)) AS e, avg((y - g) ** 2) AS q, avg((y > g)::INT) AS above FROM ({_PREDICTED}) GROUP BY ALL),
 b AS (SELECT a.family, a.study, quantile_cont(o.e, 0.5) AS be, avg(o.q) AS bq FROM s a JOIN s o ON a.family = o.family AND a.study <> o.study GROUP BY ALL)
 SELECT family, study, round(e - be, 6) AS excess, round(q / bq, 6) AS ratio, round(greatest(above, 1 - above), 6) AS same_sign, CASE WHEN e - be > 2 AND q / bq > 1.2 AND greatest(above, 1 - above) > 0.7 THEN 'systematic' WHEN e - be > 2 AND q / bq > 1.2 THEN 'noisy' WHEN e - be > 2 THEN 'shifted' WHEN e < be THEN 'better' ELSE 'usual' END AS verdict
 FROM s JOIN b USING (family, study)""")
def residual_group_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each study against the median of the other studies of its family."""
    p = _predicted(spark, sf_dir).withColumnsRenamed({"l_returnflag": "family", "l_suppkey": "study"})
    return _rounded(D.residual_audit(p, "family", "study", "y", "g").drop("rows"), ["excess", "ratio", "same_sign"])


@query("""SELECT o_custkey, o_orderpriority AS method, count(*) AS n FROM orders JOIN (SELECT o_custkey, min(['3-MEDIUM', '1-URGENT', '5-LOW'].list_position(o_orderpriority)) AS best FROM orders GROUP BY 1) USING (o_custkey) WHERE ['3-MEDIUM', '1-URGENT', '5-LOW'].list_position(o_orderpriority) = best GROUP BY ALL""")
def preferred_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the first method of a preference list that a key has; keys with none are dropped."""
    o = D.preferred_variant(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("method")), ["o_custkey"], "method", ["3-MEDIUM", "1-URGENT", "5-LOW"])
    return o.groupBy("o_custkey", "method").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT c_mktsegment, median(c_acctbal) AS m FROM customer GROUP BY 1) SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal - m), c_custkey) AS r FROM customer JOIN m USING (c_mktsegment)) WHERE r = 1""")
def representative_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row closest to its group's median, ties by id."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return D.representative(c, ["c_mktsegment"], ["c_acctbal"], ["c_custkey"])


@query("""WITH a AS (SELECT * FROM documents WHERE md5(doc_id::VARCHAR) < '4'), b AS (SELECT * FROM documents WHERE md5(doc_id::VARCHAR) >= '4') SELECT (SELECT count(*) FROM a WHERE source IN (SELECT source FROM b)) AS by_name, (SELECT count(*) FROM a WHERE md5(text) IN (SELECT md5(text) FROM b)) AS by_content, (SELECT count(*) FROM a) AS rows""")
def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one part whose name or content the other part has too."""
    d, a = table(spark, sf_dir, "documents"), F.md5(F.col("doc_id").cast("string")) < "4"
    return D.leaks(d.where(a), d.where(~a), {"by_name": F.col("source"), "by_content": F.md5("text")})


@query("""SELECT l_partkey, supp AS suppliers, flags FROM (SELECT l_partkey, string_agg(DISTINCT l_suppkey::VARCHAR, '; ' ORDER BY l_suppkey::VARCHAR) AS supp, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1)""")
def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different texts of a group, joined in an explicit order."""
    s, f = F.col("l_suppkey").cast("string"), F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(A.joined(s, s).alias("suppliers"), A.joined(f, f, ",").alias("flags"))


@query("""WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders), b AS (SELECT *, ceil((hi - lo) / (2 * iqr / pow(n, 1.0 / 3))) AS raw FROM s),
 c AS (SELECT *, CASE WHEN raw < 4 THEN least(40, greatest(4, ceil(sqrt(n)))) ELSE least(raw, 40) END::BIGINT AS bins FROM b) SELECT least(floor((o_totalprice - lo) * bins / (hi - lo)), bins - 1)::BIGINT AS bin, count(*) AS n FROM orders, c GROUP BY 1""")
def fd_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced bins, their number by Freedman and Diaconis, the last one closed."""
    return A.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 40)


@query("""SELECT o_custkey, place, round(share, 9) AS share, round(running, 9) AS running FROM (SELECT o_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, o_custkey) AS place, n / sum(n) OVER (PARTITION BY c_mktsegment) AS share,
 sum(n) OVER (PARTITION BY c_mktsegment ORDER BY n DESC, o_custkey ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY c_mktsegment) AS running FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey)""")
def study_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contribution, rank and running share."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    out = A.cumulative_share(n.join(c, "o_custkey"), "n", "o_custkey", ["c_mktsegment"])
    return out.select("o_custkey", F.col("place"), _r("share", 9).alias("share"), _r("running", 9).alias("running"))


@query("""SELECT size_bin, price_bin, count(*) AS rows, count(DISTINCT p_brand) AS units FROM (SELECT p_brand, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'middle' ELSE 'large' END AS size_bin, CASE WHEN p_retailprice < 1000 THEN 'low' ELSE 'high' END AS price_bin FROM part) GROUP BY ALL""")
def joint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint combinations with fixed bins: rows and different units."""
    s, p = F.col("p_size"), F.col("p_retailprice")
    bins = {"size_bin": F.when(s <= 10, "small").when(s <= 30, "middle").otherwise("large"), "price_bin": F.when(p < 1000, "low").otherwise("high")}
    return D.joint_coverage(table(spark, sf_dir, "part"), bins, "p_brand")


@query(f"""WITH e AS (SELECT list_distinct([quantile_cont(y, 0), quantile_cont(y, 0.25), quantile_cont(y, 0.5), quantile_cont(y, 0.75), quantile_cont(y, 1)]) AS e FROM ({_PREDICTED})), b AS (SELECT p.*, greatest(len(list_filter(e, lambda x: x < y)) - 1, 0) AS bin FROM ({_PREDICTED}) p, e)
 SELECT bin::INT AS bin, count(*) AS n, round(avg(abs(y - g)), 6) AS mae FROM b GROUP BY 1""")
def score_bin_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by quantile bin of a score."""
    b = W.quantile_bins(_predicted(spark, sf_dir), "y", 4)
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), _r(F.avg(F.abs(F.col("y") - F.col("g")))).alias("mae"))


@query("""WITH v AS (SELECT unnest(['quantity', 'discount', 'tax']) AS feature, unnest([l_quantity / 50, l_discount * 10, l_tax * 10]) AS v, l_extendedprice / 1000 AS w FROM lineitem), i AS (SELECT feature, sum(w * abs(v)) / sum(w) AS importance FROM v GROUP BY 1) SELECT feature, round(importance, 6) AS importance, rank() OVER (ORDER BY round(importance, 6) DESC) AS place FROM i""")
def importance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean absolute value per feature and its minimum rank."""
    parts = {"quantity": F.col("l_quantity") / 50, "discount": F.col("l_discount") * 10, "tax": F.col("l_tax") * 10}
    return D.importance(table(spark, sf_dir, "lineitem"), parts, F.col("l_extendedprice") / 1000)
