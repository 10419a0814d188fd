"""Curation operators on the driver's tables, and the flagship ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import aggregate as A
from ..operators import curation as C
from ..operators import match as M
from ..operators import window as W
from .registry import Registry, table

plans = Registry()
query = plans.query


@query("""WITH r AS (SELECT l_partkey, avg(l_quantity) AS want FROM lineitem GROUP BY 1), e AS (SELECT l_partkey, l_suppkey, l_extendedprice / l_quantity AS s FROM lineitem JOIN r USING (l_partkey) WHERE abs(l_quantity - want) / 10 <= 1 + 1e-12),
 i AS (SELECT l_partkey, l_suppkey, quantile_cont(s, 0.5) AS m FROM e GROUP BY ALL), d AS (SELECT l_partkey, quantile_cont(m, 0.5) AS score, count(*) AS studies FROM i GROUP BY 1),
 a AS (SELECT p_partkey, p_brand, p_type, round(coalesce(score, p_retailprice), 6) AS score, CASE WHEN score IS NULL THEN 'fallback' ELSE 'database' END AS basis, coalesce(studies, 0) AS studies FROM part LEFT JOIN d ON l_partkey = p_partkey),
 n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY score DESC, p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS c FROM a), p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY c > 20 AND i > 2, score DESC, p_partkey) AS place FROM n)
 SELECT p_brand, p_partkey, score, basis, studies, place, max(score) OVER (PARTITION BY p_brand) - score <= 5 AS near_top FROM p WHERE place <= 20""")
def database_first_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched evidence, study-balanced median, fallback score where there is none, diverse top 20 per brand, gap to the top."""
    line = table(spark, sf_dir, "lineitem")
    wanted = line.groupBy("l_partkey").agg(F.avg("l_quantity").alias("want_q"))
    seen = line.select("l_partkey", "l_suppkey", F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("s"))
    found = M.tolerance_match(wanted, seen, ["l_partkey"], {"q": M.Tolerance(10.0)})
    scores = A.nested_median(found, ["l_partkey"], "l_suppkey", "s").drop("rows")
    p = table(spark, sf_dir, "part").join(scores.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "left")
    p = p.select("p_partkey", "p_brand", "p_type", F.round(F.coalesce("score", "p_retailprice"), 6).alias("score"), F.when(F.col("score").isNull(), "fallback").otherwise("database").alias("basis"), F.coalesce("studies", F.lit(0)).alias("studies"))
    top = W.diverse_top(p, ["p_brand"], "p_type", "score", "p_partkey", 20)
    return top.withColumn("near_top", W.gap_to_top("score", ["p_brand"], 5.0)).drop("p_type")


@query("""WITH m AS (SELECT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS k, min('canon ' || p_brand) AS c FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'given' ELSE coalesce(x.c, y.c) END AS name
 FROM part LEFT JOIN m x ON x.k = CASE WHEN p_partkey % 3 = 0 THEN 'nothing' ELSE regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') END LEFT JOIN m y ON y.k = regexp_replace(lower('BRAND ' || p_size), '[^a-z0-9]', '', 'g')""")
def vocabulary_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical names over source columns in order, only where the target is blank."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    m = p.select(F.col("p_brand").alias("key"), F.concat(F.lit("canon "), "p_brand").alias("canonical")).distinct()
    d = p.select("p_partkey", F.when(k % 4 == 0, "given").otherwise("").alias("own"), F.when(k % 3 == 0, "nothing").otherwise(F.lower("p_brand")).alias("a"), F.concat(F.lit("BRAND "), F.col("p_size").cast("string")).alias("b"))
    return C.map_values(d, ["a", "b"], m, "name", blank_only="own").select("p_partkey", "name")


@query("""SELECT p_partkey, CASE WHEN p_type ILIKE '%econ%' THEN 'cheap' WHEN p_type ILIKE '%small%' OR p_type ILIKE '%medium%' THEN 'handy' ELSE 'unclassified' END AS label, CASE WHEN p_size > 25 THEN 'Large' ELSE 'Small' END AS size_label FROM part""")
def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by ordered patterns, labels by map."""
    names = F.create_map(F.lit(True), F.lit("Large"), F.lit(False), F.lit("Small"))
    return table(spark, sf_dir, "part").select("p_partkey", C.label_by_rules(F.col("p_type"), [("econ", "cheap"), ("small|medium", "handy")], "unclassified").alias("label"), names[F.col("p_size") > 25].alias("size_label"))


@query("""SELECT p_partkey, round(p_size * 1000 / pow(0.001, 0.5), 6) AS kf, 'mg/g/(mg/l)^1/n' AS kf_unit, round((p_size + p_size + 2) / 2 * 0.001, 9) AS grain, round(CASE WHEN p_partkey % 2 = 0 THEN p_size / 1000 ELSE p_size / 1000 / 40 END, 12) AS molar,
 CASE p_partkey % 3 WHEN 0 THEN p_size || '; 5 mg' WHEN 1 THEN '0.5 mg/mL' ELSE 'plain' END AS joined, p_size::VARCHAR AS a, 'x' AS b FROM part""")
def unit_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freundlich constants and units, grain sizes, molar concentrations, joined cells, packed descriptors."""
    s, t, k = F.col("p_size"), F.col("p_size").cast("string"), F.col("p_partkey")
    cell = F.when(k % 3 == 0, F.concat(t, F.lit(" mg and 5 mg"))).when(k % 3 == 1, "5 mg/10_mL").otherwise("plain")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(C.freundlich_constant(s, F.lit(0.5), F.lit(1000.0), F.lit(0.001)), 6).alias("kf"), C.inferred_kf_unit(F.lit("mg/g"), F.lit("L/mg"), F.lit("1/n")).alias("kf_unit"),
        F.round(C.grain_size_mm(F.concat_ws("-", t, (s + 2).cast("string")), F.lit("µm")), 9).alias("grain"), F.round(C.to_molar(s, F.when(k % 2 == 0, "mM").otherwise("mg/L"), F.lit(40.0)), 12).alias("molar"),
        C.joined_value_units(cell).alias("joined"), *C.descriptors(F.concat(F.lit("A: "), t, F.lit("; b=x; a=9")), ["a", "b"]),
    )


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR NOT p_type LIKE 'SMALL%' THEN p_size END AS value, CASE WHEN p_partkey % 5 <> 0 THEN NOT p_type LIKE 'SMALL%' END AS applicable, CASE WHEN p_partkey % 5 <> 0 AND p_type LIKE 'SMALL%' AND p_size <> 0 THEN 'size does not apply' END AS warning FROM part""")
def not_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that don't apply to a category are told from missing ones."""
    p = table(spark, sf_dir, "part")
    category = F.when(F.col("p_partkey") % 5 != 0, F.when(F.col("p_type").startswith("SMALL"), "small").otherwise("other"))
    return p.select("p_partkey", C.applicable(F.col("p_size"), category, {"small": ["size"]}, "size").alias("a")).select("p_partkey", "a.*")


@query("""SELECT p_partkey, concat_ws('; ', CASE WHEN p_size > 40 THEN 'other' END, CASE WHEN p_size > 10 THEN 'range' END, 'unit') AS labels, CASE WHEN p_size > 10 THEN 2 ELSE 1 END AS priority FROM part""")
def fragment_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note fragments by rule, the row's highest priority."""
    s = F.col("p_size")
    notes = F.concat_ws("; ", F.lit("unit mg unknown"), F.when(s > 10, "Range collapsed"), F.when(s > 40, "odd"))
    return C.classify_fragments(table(spark, sf_dir, "part").select("p_partkey", notes.alias("n")), "p_partkey", "n", [("^unit", "unit", 1), ("range", "range", 2)])


@query("""SELECT p_partkey, CASE WHEN p_size > 10 THEN 'specific::' || regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') WHEN p_partkey % 2 = 0 THEN 'study::' || p_brand || '::id' || p_size ELSE 'row::' || p_brand || '::' || p_partkey END AS key, CASE WHEN p_size > 10 THEN 'name' WHEN p_partkey % 2 = 0 THEN 'study id' ELSE 'row' END AS basis FROM part""")
def identity_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conservative identity key and what it rests on."""
    k, s = F.col("p_partkey"), F.col("p_size")
    key, basis = C.specific_identity(F.when(s > 10, "specific").otherwise("generic"), F.col("p_name"), F.col("p_brand"), F.when(k % 2 == 0, F.concat(F.lit("id"), s.cast("string"))), k)
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("key"), basis.alias("basis"))


@query("""WITH t AS (SELECT unnest([p_brand, p_brand || p_size]) AS alias, p_partkey, p_retailprice FROM part) SELECT alias, min(p_partkey) AS p_partkey, min_by(p_retailprice, p_partkey) AS p_retailprice FROM t GROUP BY 1""")
def alias_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per identifier, the first record of each."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.col("p_brand").alias("x"), F.concat("p_brand", F.col("p_size").cast("string")).alias("y"))
    return C.alias_dimension(p, ["x", "y"], "p_partkey").select("alias", "p_partkey", "p_retailprice")


@query("""WITH l AS (SELECT p_partkey, lower(p_brand) || '|' || p_size || '|w|' || 'ph=7,t=' || (p_size % 3) AS k FROM part WHERE p_partkey % 2 = 0), r AS (SELECT p_partkey AS q, lower(p_brand) || '|' || p_size || '|w|' || 'ph=7,t=' || (p_size % 3) AS k FROM part WHERE p_partkey % 2 = 1)
 SELECT min(p_partkey) AS left_id, min(q) AS right_id, k AS key FROM l JOIN r USING (k) GROUP BY k HAVING count(DISTINCT p_partkey) = 1 AND count(DISTINCT q) = 1""")
def canonical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite ids with their condition tokens in order and equivalent names replaced, paired where unique on both sides."""
    p, s = table(spark, sf_dir, "part"), F.col("p_size")
    t = F.concat(F.lit("t="), (s % 3).cast("string"))
    make = lambda d, water, cond, name: d.select(F.col("p_partkey").alias(name), C.canonical_id(F.concat_ws(" | ", "p_brand", s.cast("string"), F.lit(water), cond), {"water": "w"}).alias("key"))
    left = make(p.where("p_partkey % 2 = 0"), "Water", F.concat(t, F.lit("; pH=7")), "left_id")
    right = make(p.where("p_partkey % 2 = 1"), "W", F.concat(F.lit("pH=7, "), t), "right_id")
    return C.unique_pairs(left, right, "key", "left_id", "right_id").select("left_id", "right_id", "key")


@query("""WITH t AS (SELECT p_partkey AS t FROM part WHERE p_partkey % 3 <> 0), g AS (SELECT p_partkey AS g FROM part WHERE p_partkey % 4 <> 0), a AS (SELECT t FROM t JOIN g ON t = g WHERE t % 5 <> 0), b AS (SELECT t FROM t JOIN g ON t = g WHERE t % 5 = 0 AND t % 7 <> 0)
 SELECT 'exact' AS stage, (SELECT count(*) FROM a) AS n UNION ALL SELECT 'canonical', (SELECT count(*) FROM b) UNION ALL SELECT 'fn', (SELECT count(*) FROM t) - (SELECT count(*) FROM a) - (SELECT count(*) FROM b) UNION ALL SELECT 'fp', (SELECT count(*) FROM g) - (SELECT count(*) FROM a) - (SELECT count(*) FROM b)""")
def staged_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, then canonical matches, then what is left on either side."""
    p = table(spark, sf_dir, "part")
    t, g = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("t")), p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("g"))
    same = p.select(F.col("p_partkey").alias("t"), F.col("p_partkey").alias("g"))
    return C.staged_evaluation(t, g, [("exact", same.where("t % 5 <> 0")), ("canonical", same.where("t % 7 <> 0"))])


@query("""SELECT o_orderstatus, count(*) AS n, 'unknown o_orderstatus: Z' AS warnings FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority = '1-URGENT' GROUP BY 1""")
def category_and_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories with warnings about unknown ones, clauses."""
    kept, warnings = C.category_filter(table(spark, sf_dir, "orders"), "o_orderstatus", ["O", "F", "Z"])
    return C.clause_filter(kept, ["o_orderpriority=1-URGENT"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.lit("; ".join(warnings)).alias("warnings"))


@query("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'replaced' ELSE 'kept' END AS action FROM part UNION ALL SELECT CASE p_partkey % 4 WHEN 1 THEN 'refused' WHEN 2 THEN 'appended' END FROM part WHERE p_partkey % 4 IN (1, 2)) GROUP BY 1""")
def envelope_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal envelopes replace, partial overlaps are refused, the rest is appended."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    text = lambda c: c.cast("string")
    old = p.select("p_partkey", F.array(text(k), F.concat(text(k), F.lit("b"))).alias("sources"))
    new = p.where("p_partkey % 4 < 3").select("p_partkey", F.when(k % 4 == 0, F.array(F.concat(text(k), F.lit("b")), text(k))).when(k % 4 == 1, F.array(text(k), F.concat(text(k), F.lit("z")))).otherwise(F.array(F.concat(text(k), F.lit("new")))).alias("sources"))
    return C.envelope_upsert(old, new, "p_partkey", "sources").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT l_returnflag, l_extendedprice / 1000 - l_quantity AS r, unnest(['q', 'd']) AS feature, unnest([l_quantity, l_discount]) AS v FROM lineitem), c AS (SELECT feature, l_returnflag, corr(v, r) AS c FROM v GROUP BY ALL) SELECT feature, count(*) AS assignments, CASE WHEN min(c) > 0 THEN 1 WHEN max(c) < 0 THEN -1 ELSE 0 END AS sign, round(median(c), 6) AS strength FROM c GROUP BY 1""")
def residual_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose correlation with the residual keeps its sign over all assignments."""
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000 - F.col("l_quantity")).alias("r"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    return C.screen_residuals(l, "l_returnflag", "r", ["q", "d"]).withColumn("strength", F.round("strength", 6))


@query("""SELECT label, count(*) AS n FROM (SELECT CASE WHEN t IS NULL THEN '' WHEN mx = mn THEN 'single_time' WHEN t = mx THEN 'equilibrium' ELSE 'non_equilibrium' END AS label FROM (SELECT t, max(t) OVER (PARTITION BY user_id) AS mx, min(t) OVER (PARTITION BY user_id) AS mn FROM (SELECT user_id, CASE WHEN event_id % 10 <> 0 THEN event_id::DOUBLE END AS t FROM events))) GROUP BY 1""")
def equilibrium_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows routed to disjoint projections; rows with an empty label go to none."""
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 10 != 0, F.col("event_id").cast("double")).alias("t"))
    label = W.last_time_label("t", ["user_id"])
    routes = F.create_map(*[F.lit(x) for p in (("unclear", ""), ("single", "single_time"), ("last", "equilibrium"), ("intermediate", "non_equilibrium")) for x in p])
    return e.select(label.alias("l")).groupBy(routes[F.col("l")].alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn % 2 = 0 THEN text END, ''), CASE WHEN turn % 3 = 0 THEN role END, 'default') AS v FROM conversations""")
def request_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first present key over alternatives, then a fallback."""
    t = F.col("turn")
    v = F.coalesce(X.first_nonblank(F.when(t % 2 == 0, F.col("text")), F.when(t % 3 == 0, F.col("role"))), F.lit("default"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", v.alias("v"))


@query("""WITH f AS (SELECT l_orderkey, l_quantity < 3 AS low, l_discount > 0.09 AS high, l_tax = 0 AS flat, l_linenumber = 7 AS human, l_returnflag FROM lineitem) SELECT count(*) AS rows, count(*) FILTER (low) AS low, count(*) FILTER (high) AS high, count(*) FILTER (flat) AS flat, count(*) FILTER (human) AS human, count(*) FILTER (low AND high) AS both,
 count(*) FILTER (NOT (low OR high OR flat OR human)) AS kept, count(DISTINCT l_orderkey) FILTER (NOT (low OR high OR flat OR human)) AS kept_sources, count(*) FILTER (NOT (low OR high OR flat OR human) AND l_returnflag = 'N') AS cohort FROM f""")
def qc_drop_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-exclusive flag counts, what stays, and the cohort gate after it, in one pass."""
    c = F.col
    flags = {"low": c("l_quantity") < 3, "high": c("l_discount") > 0.09, "flat": c("l_tax") == 0, "human": c("l_linenumber") == 7}
    ok = ~(flags["low"] | flags["high"] | flags["flat"] | flags["human"])
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(v).alias(k) for k, v in flags.items()], F.count_if(flags["low"] & flags["high"]).alias("both"), F.count_if(ok).alias("kept"), F.count_distinct(F.when(ok, c("l_orderkey"))).alias("kept_sources"), F.count_if(ok & (c("l_returnflag") == "N")).alias("cohort"))


@query("""WITH b AS (SELECT p_brand FROM part GROUP BY 1 HAVING bool_or(p_size % 7 = 0 AND p_retailprice > 1500)) SELECT p_brand, count(*) AS rows, p_brand IN (SELECT p_brand FROM b) AS failed FROM part GROUP BY 1""")
def entity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity with one incomplete row fails as a whole and is listed."""
    bad = (F.col("p_size") % 7 == 0) & (F.col("p_retailprice") > 1500)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("rows"), F.bool_or(bad).alias("failed"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN l_quantity * 1000 WHEN l_partkey % 3 = 1 THEN l_quantity END AS mass_std, CASE WHEN l_partkey % 3 = 2 THEN 'unit mismatch' END AS mass_reason, round(l_discount * 24, 9) AS time_std, NULL::VARCHAR AS time_reason FROM lineitem""")
def unit_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several columns converted by a table of specs."""
    k = F.col("l_partkey") % 3
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("mass"), F.when(k == 0, "g").when(k == 1, "mg").otherwise("L").alias("mass_unit"), F.col("l_discount").alias("time"), F.lit("days").alias("time_unit"))
    out = C.convert_all(l, {"mass": ("mass_unit", "mass", None), "time": ("time_unit", "time", None)})
    return out.select("l_orderkey", "l_linenumber", "mass_std", "mass_reason", F.round("time_std", 9).alias("time_std"), "time_reason")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 3 THEN p_size::DOUBLE END AS ph, CASE p_partkey % 4 WHEN 1 THEN p_size || '-' || (p_size + 2) WHEN 2 THEN p_size || '; 9' END AS ph_context FROM part""")
def range_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges and lists as context text, uncertain values by their centre."""
    k, t = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    ph = F.when(k == 0, t).when(k == 1, F.concat(t, F.lit("-"), (F.col("p_size") + 2).cast("string"))).when(k == 2, F.concat(t, F.lit("; 9"))).otherwise(F.concat(t, F.lit(" ± 0.2")))
    return C.range_context(table(spark, sf_dir, "part").select("p_partkey", ph.alias("ph")), ["ph"]).select("p_partkey", "ph", "ph_context")


@query("""SELECT a.p_partkey AS left_id, b.p_partkey AS right_id FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1 WHERE (a.p_partkey % 3 = b.p_partkey % 3 OR (a.p_partkey % 3 = 2 AND b.p_partkey % 3 = 0) OR (a.p_partkey % 3 = 0 AND b.p_partkey % 3 = 2))""")
def plausible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of composite ids with equal slots whose conditions don't contradict."""
    k, p = F.col("p_partkey") % 3, table(spark, sf_dir, "part")
    cond = F.when(k == 0, "ph=7,dark").when(k == 1, "ph=8").otherwise("ph=7,stirred")
    make = lambda d, n: d.select(F.col("p_partkey").alias(n), C.canonical_id(F.concat_ws("|", "p_brand", F.col("p_size").cast("string"), F.lit("w"), cond)).alias("key"))
    return C.plausible_pairs(make(p.where("p_partkey % 2 = 0"), "left_id"), make(p.where("p_partkey % 2 = 1"), "right_id"), "left_id", "right_id")


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN replace(text, 'the', 'THE') ELSE text END AS text, conv_id % 2 = 0 AND contains(text, 'the') AS replaced FROM conversations""")
def text_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved replacements wherever the text stands."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    d = c.where("conv_id % 2 = 0").select("conv_id", F.lit("the").alias("old"), F.lit("THE").alias("new")).distinct()
    return C.replace_texts(c, d, "conv_id", "text").select("conv_id", "turn", "text", "replaced")


@query("""SELECT feature, present, count(*) AS n, round(avg(abs(y - g)), 6) AS mae FROM (SELECT y, g, unnest(['tax', 'discount']) AS feature, unnest([l_tax > 0.01, l_discount > 0.02]) AS present FROM (SELECT l_extendedprice / 1000 AS y, l_quantity AS g, l_tax, l_discount FROM lineitem)) GROUP BY ALL""")
def metrics_by_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics where a feature is present and where it is missing."""
    l = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("g"), F.when(F.col("l_tax") > 0.01, 1).alias("tax"), F.when(F.col("l_discount") > 0.02, 1).alias("discount"))
    return A.metrics_by_availability(l, ["tax", "discount"], "y", "g").select("feature", "present", "n", F.round("mae", 6).alias("mae"))


@query("""SELECT l_returnflag, l_partkey, count(DISTINCT l_suppkey) AS selected, any_value(r.runs) AS runs, round(count(DISTINCT l_suppkey) / any_value(r.runs), 9) AS share FROM lineitem JOIN (SELECT l_returnflag, count(DISTINCT l_suppkey) AS runs FROM lineitem GROUP BY 1) r USING (l_returnflag) GROUP BY ALL""")
def feature_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many runs of a configuration a feature was selected; flags, suppliers and parts stand for them."""
    return A.stability(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey", "l_partkey").withColumn("share", F.round("share", 9))
