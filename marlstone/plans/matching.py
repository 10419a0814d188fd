"""Matching operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit as D
from ..operators import match as M
from .registry import Registry, table

plans = Registry()
query = plans.query

_REQUESTS = """SELECT l_partkey, l_suppkey, round(avg(l_quantity), 4) AS want_q, round(max(l_extendedprice), 2) AS want_p FROM lineitem GROUP BY ALL"""
_TOLERANT = f"""SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_discount, round((abs(l_quantity - want_q) / 10 + abs(log10(l_extendedprice) - log10(want_p)) / 0.3) / 2, 9) AS distance
 FROM lineitem JOIN ({_REQUESTS}) USING (l_partkey, l_suppkey)
 WHERE abs(l_quantity - want_q) / 10 <= 1 + 1e-12 AND abs(log10(l_extendedprice) - log10(want_p)) / 0.3 <= 1 + 1e-12 AND l_returnflag <> 'R'"""
FIELDS = {"q": M.Tolerance(10.0), "p": M.Tolerance(0.3, True)}


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem")
    wanted = line.groupBy("l_partkey", "l_suppkey").agg(F.round(F.avg("l_quantity"), 4).alias("want_q"), F.round(F.max("l_extendedprice"), 2).alias("want_p"))
    seen = line.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_discount", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), (F.col("l_returnflag") != "R").alias("usable"))
    return wanted, seen


@query(f"SELECT * FROM ({_TOLERANT})")
def tolerance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact identities, then every requested number within its tolerance."""
    wanted, seen = _requests(spark, sf_dir)
    return M.tolerance_match(wanted, seen, ["l_partkey", "l_suppkey"], FIELDS, ["usable"]).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_discount", F.round("distance", 9).alias("distance"))


@query(
    f"""SELECT * FROM (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber,
 row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY distance, l_discount DESC NULLS LAST, l_orderkey, l_linenumber) AS place FROM ({_TOLERANT})) WHERE place <= 3"""
)
def ordered_match_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by mean distance, then fit quality (missing last), then stable id; the first three."""
    order = [F.asc("distance"), F.desc_nulls_last("l_discount"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return M.best_matches(tolerance_match(spark, sf_dir), ["l_partkey", "l_suppkey"], order, 3).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "place")


@query(
    f"""SELECT reason, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey)) AS n_requests FROM (
 SELECT l_partkey, l_suppkey, unnest(list_filter([CASE WHEN NOT abs(l_quantity - want_q) / 10 <= 1 + 1e-12 THEN 'q out of tolerance' END,
   CASE WHEN NOT abs(log10(l_extendedprice) - log10(want_p)) / 0.3 <= 1 + 1e-12 THEN 'p out of tolerance' END], lambda x: x IS NOT NULL)) AS reason
 FROM lineitem JOIN ({_REQUESTS}) USING (l_partkey, l_suppkey)) GROUP BY reason"""
)
def related_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same identity but not comparable, by reason."""
    wanted, seen = _requests(spark, sf_dir)
    found = M.exclusion_reasons(wanted, seen, ["l_partkey", "l_suppkey"], FIELDS).select("l_partkey", "l_suppkey", F.explode("reasons").alias("reason"))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("n_requests"))


@query(
    """SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END, ''), c_mktsegment) AS note, c_acctbal AS balance
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""
)
def enrich_fill_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row per key fills blank cells and adds columns."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("note"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("note"), F.col("c_acctbal").alias("balance"), F.lit(0).alias("rank"))
    c = c.unionByName(c.withColumns({"note": F.lit("later"), "rank": F.lit(1)}))
    return M.fill_blanks(o, c, "key", [F.col("rank")]).select("o_orderkey", "note", "balance")


@query(
    """WITH u AS (SELECT p_brand || p_size AS alias, min(p_partkey) AS id FROM part GROUP BY 1 HAVING count(*) = 1),
 v AS (SELECT p_type AS vendor, min(p_partkey) AS id FROM part GROUP BY 1 HAVING count(*) = 1)
 SELECT k, coalesce(p.p_partkey, u.id, v.id) AS id, CASE WHEN p.p_partkey IS NOT NULL THEN 'k' WHEN u.id IS NOT NULL THEN 'alias' WHEN v.id IS NOT NULL THEN 'vendor' END AS matched_by
 FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS exact, p_brand || p_size AS alias, p_type AS vendor FROM part) a
 LEFT JOIN part p ON a.exact = p.p_partkey LEFT JOIN u USING (alias) LEFT JOIN v USING (vendor)"""
)
def cascading_unique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact id, else an alias with one candidate, else a vendor with one."""
    p, alias = table(spark, sf_dir, "part"), F.concat("p_brand", F.col("p_size").cast("string"))
    left = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("k"), alias.alias("alias"), F.col("p_type").alias("vendor"))
    facts = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("k"), alias.alias("alias"), F.col("p_type").alias("vendor"))
    found = M.cascade(left, [(c, M.unique_index(facts, c, "id")) for c in ("k", "alias", "vendor")], "id")
    return found.select(F.col("p_partkey").alias("k"), "id", "matched_by")


@query(
    """SELECT c_custkey, s_suppkey, count(DISTINCT a) AS shared FROM (SELECT c_custkey, unnest([c_nationkey::VARCHAR, right(c_name, 2), c_mktsegment]) AS a FROM customer)
 JOIN (SELECT s_suppkey, unnest([s_nationkey::VARCHAR, right(s_name, 2), 'none']) AS a FROM supplier) USING (a) GROUP BY ALL"""
)
def alias_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers that share a normalised alias."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.col("c_nationkey").cast("string"), F.right("c_name", F.lit(2)), F.col("c_mktsegment")).alias("a"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.col("s_nationkey").cast("string"), F.right("s_name", F.lit(2)), F.lit("none")).alias("a"))
    return M.alias_pairs(c, "c_custkey", "a", s, "s_suppkey", "a")


@query(
    """SELECT p_partkey, coalesce(e.p_type, f.t, CASE WHEN p_partkey % 5 = 4 THEN 'nowhere' ELSE v END) AS aligned FROM (
 SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) WHEN 2 THEN ' ' || p_type WHEN 3 THEN '7.0' ELSE 'nowhere' END AS v FROM part) a
 LEFT JOIN (SELECT DISTINCT p_type FROM part UNION SELECT '7') e ON e.p_type = v
 LEFT JOIN (SELECT lower(trim(p_type)) AS k, min(p_type) AS t FROM part GROUP BY 1 UNION ALL SELECT '7.0', '7') f ON f.k = lower(trim(v))"""
)
def level_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values aligned to observed levels: exact, folded, numeric, else as they are."""
    p, k, t = table(spark, sf_dir, "part"), F.col("p_partkey") % 5, F.col("p_type")
    v = F.when(k == 0, t).when(k == 1, F.lower(t)).when(k == 2, F.concat(F.lit(" "), t)).when(k == 3, "7.0").otherwise("nowhere")
    levels = p.select(t.alias("level")).unionByName(p.sparkSession.range(1).select(F.lit("7").alias("level")))
    return M.align_level(p.select("p_partkey", v.alias("v")), "v", levels, "level").select("p_partkey", "aligned")


@query("""SELECT p_brand || p_size AS alias, min(p_type) AS class FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1""")
def equivalence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that stand in one class only."""
    p = table(spark, sf_dir, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("alias"), F.col("p_type").alias("class"))
    return M.stable_aliases(p, "class", "alias")


@query(
    """WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS brand, p_type AS kind FROM part),
 s AS (SELECT p_partkey, 'Brand#' || p_size AS brand, CASE WHEN p_partkey % 4 <> 0 THEN 'OTHER' ELSE '' END AS kind FROM part WHERE p_size > 10)
 SELECT b.p_partkey, coalesce(nullif(b.brand, ''), s.brand, '') AS brand, CASE WHEN b.brand <> '' THEN 'unchanged' WHEN s.brand IS NOT NULL THEN 'filled' ELSE 'blank' END AS brand_from,
 coalesce(nullif(s.kind, ''), b.kind) AS kind, CASE WHEN nullif(s.kind, '') IS NOT NULL AND s.kind <> b.kind THEN 'overridden' ELSE 'unchanged' END AS kind_from
 FROM b LEFT JOIN s USING (p_partkey)"""
)
def source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second source fills one column and overrides another, with an audit."""
    p = table(spark, sf_dir, "part")
    base = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")).alias("brand"), F.col("p_type").alias("kind"))
    second = p.where("p_size > 10").select("p_partkey", F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("brand"), F.when(F.col("p_partkey") % 4 != 0, "OTHER").otherwise("").alias("kind"))
    return M.merge_sources(base, second, "p_partkey", {"brand": "fill", "kind": "override"})


@query(
    """SELECT n_nationkey, l.v AS left_value, r.v AS right_value, CASE WHEN l.v IS NULL THEN 'only right' WHEN r.v IS NULL THEN 'only left' ELSE 'both' END AS note,
 CASE WHEN l.v > 1 THEN r.v - l.v END AS delta FROM (SELECT s_nationkey AS n_nationkey, count(*) AS v FROM supplier WHERE s_acctbal > 0 GROUP BY 1) l
 FULL JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS v FROM customer WHERE c_acctbal < 0 GROUP BY 1) r USING (n_nationkey)"""
)
def snapshot_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-outer comparison with notes on the missing side."""
    l = table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("v"))
    r = table(spark, sf_dir, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("v"))
    return M.compare_snapshots(l, r, "n_nationkey", "v", F.col("left_value") > 1)


@query(
    """SELECT p_partkey, CASE WHEN p_size < 25 AND p_partkey % 2 = 0 THEN 'ruled' ELSE p_brand END AS p_brand, p_size < 25 AND p_partkey % 2 = 0 AS overridden FROM part"""
)
def guarded_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewed value replaces the raw one only where that is still what the reviewer saw."""
    p = table(spark, sf_dir, "part")
    seen = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("stale")
    o = p.where("p_size < 25").select("p_partkey", seen.alias("expected"), F.lit("ruled").alias("value"))
    return M.guarded_override(p.select("p_partkey", "p_brand"), o, "p_partkey", "p_brand")


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice, 'new' AS origin FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'
 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 'old' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P')"""
)
def incremental_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the selected keys are dropped, the new ones appended."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    new = o.where("o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'").drop("o_orderpriority", "o_orderstatus").withColumn("origin", F.lit("new"))
    return M.replace_rows(o.drop("o_orderpriority", "o_orderstatus").withColumn("origin", F.lit("old")), new, new, ["o_custkey"])


@query(
    """SELECT a.o_custkey, a.p AS method, b.p AS reference, round(a.v - b.v, 4) AS delta FROM
 (SELECT o_custkey, o_orderpriority AS p, avg(o_totalprice) AS v FROM orders GROUP BY ALL) a JOIN (SELECT o_custkey, o_orderpriority AS p, avg(o_totalprice) AS v FROM orders GROUP BY ALL) b
 ON a.o_custkey = b.o_custkey AND b.p = '1-URGENT' AND a.p <> '1-URGENT'"""
)
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method against the reference method on the same key."""
    m = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("method")).agg(F.avg("o_totalprice").alias("v"))
    ref = m.where("method = '1-URGENT'").select("o_custkey", F.col("method").alias("reference"), F.col("v").alias("w"))
    return m.where("method <> '1-URGENT'").join(ref, "o_custkey").select("o_custkey", "method", "reference", F.round(F.col("v") - F.col("w"), 4).alias("delta"))


@query("""SELECT o_orderkey, n_lines, c_name FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey""")
def validated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-to-one join that fails on repeated keys, then a left join."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n_lines"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return M.checked_join(o, l, ["key"]).join(c, "o_custkey", "left").select(F.col("key").alias("o_orderkey"), "n_lines", "c_name")


@query(
    """WITH n AS (SELECT doc_id, source, lang, md5(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents),
 a AS (SELECT *, row_number() OVER (PARTITION BY lang, h ORDER BY doc_id) AS r FROM n WHERE doc_id % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY lang, h ORDER BY doc_id) AS r FROM n WHERE doc_id % 2 = 1)
 SELECT a.doc_id AS old_id, b.doc_id AS new_id, lang FROM a JOIN b USING (lang, h, r)"""
)
def exact_chunk_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches of equal normalised content, first in first out. Even ids stand for the old version, odd ones for the new."""
    n = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.lower(F.regexp_replace("text", r"\s+", " "))).alias("h"))
    return M.fifo_pairs(n.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "old_id"), n.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "new_id"), ["lang", "h"], "old_id", "new_id").drop("h")


@query("""SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""")
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-join to targets, anti-join to what is known."""
    o = table(spark, sf_dir, "orders")
    with_priority = lambda p: o.where(F.col("o_orderpriority") == p).select("o_custkey")
    return M.unseen(o, with_priority("5-LOW"), ["o_custkey"]).join(with_priority("1-URGENT"), "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT l_partkey, min(l_suppkey) FILTER (WHERE price = m) AS best_supplier, min(price) AS low, count(*) AS n FROM (SELECT *, min(price) OVER (PARTITION BY l_partkey) AS m
 FROM (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY ALL)) GROUP BY 1"""
)
def mixture_maximin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key the least score, where it comes from (ties by id), and how many."""
    s = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return D.mixture_ranking(s, "l_partkey", "l_suppkey", "price").select("l_partkey", F.col("limiting").alias("best_supplier"), F.col("worst").alias("low"), F.col("members").alias("n"))


_RELATED = f"""SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_returnflag, abs(l_quantity - want_q) / 10 AS dq, abs(log10(l_extendedprice) - log10(want_p)) / 0.3 AS dp FROM lineitem JOIN ({_REQUESTS}) USING (l_partkey, l_suppkey)"""


@query(
    f"""WITH r AS (SELECT *, (dq > 1 + 1e-12)::INT + (dp > 1 + 1e-12)::INT AS differences, round(dq + dp, 9) AS s FROM ({_RELATED}) WHERE dq > 1 + 1e-12 OR dp > 1 + 1e-12),
 f AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag ORDER BY differences, dq + dp, l_orderkey, l_linenumber) AS i FROM r)
 SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, differences::INT AS differences, s AS distance_sum, place FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY i > 1, differences, dq + dp, l_orderkey, l_linenumber) AS place FROM f) WHERE place <= 3"""
)
def related_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related evidence, the best of each study first, then the others; return flags stand for studies."""
    line = table(spark, sf_dir, "lineitem")
    wanted, _ = _requests(spark, sf_dir)
    seen = line.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    found = M.related_pick(wanted, seen, ["l_partkey", "l_suppkey"], FIELDS, "l_returnflag", ["l_orderkey", "l_linenumber"], 3)
    return found.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "differences", F.round("distance_sum", 9).alias("distance_sum"), "place")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN t ELSE 'other kind (x)' END AS aligned FROM part JOIN (SELECT min(p_type) AS t, lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '', 'g')) AS k FROM part GROUP BY 2) ON k = lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '', 'g'))"""
)
def qualified_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels found without their qualifier in parentheses, by letters and digits alone."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    v = F.when(k == 0, F.concat(F.lower("p_type"), F.lit(" (Type II)"))).when(k == 1, F.concat(F.regexp_replace("p_type", " ", "-"), F.lit("(A)"))).otherwise("other kind (x)")
    return M.align_level(p.select("p_partkey", v.alias("v")), "v", p.select("p_type"), "p_type", qualified=True).select("p_partkey", "aligned")


@query(
    """WITH c AS (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS price, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1)
 SELECT c_custkey, price AS o_totalprice, status AS o_orderstatus, o_custkey IS NOT NULL AS hit FROM customer LEFT JOIN c ON o_custkey = c_custkey"""
)
def cache_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row per key of a cache, reindexed onto the wanted keys, with a hit mask."""
    cache = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), "o_orderkey", "o_totalprice", "o_orderstatus")
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("wanted"))
    return D.align_cache(cache, "key", "o_orderkey", wanted, "wanted").drop("wanted")


@query(
    """SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN 'v' || n_nationkey WHEN n_nationkey % 5 = 0 THEN 'other' END AS kd_value, 'ok' AS unit,
 concat_ws('; ', CASE WHEN n_nationkey % 3 = 0 THEN 'careful' END, CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey % 5 = 0 THEN 'Conflicting repeated field ''kd_value'' kept first value' END) AS warning_message,
 CASE WHEN n_nationkey % 2 = 0 THEN 'Yes' END AS require_review, CASE WHEN n_nationkey % 2 = 0 THEN 'Ingest error: Unsupported retired field ''Old Unit''; use ''unit''' ELSE '' END AS review_reason FROM nation"""
)
def record_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names in folded form, retired fields as errors, the first of conflicting values, hidden names left out."""
    k = F.col("n_nationkey")
    item = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    items = F.array(
        item("KD Value", F.when(k % 4 != 0, F.concat(F.lit("v"), k.cast("string"))).otherwise(F.lit(" "))), item("_hidden", F.lit("hidden")), item("UNIT", F.lit("ok")), item("kd_value", F.when(k % 5 == 0, F.lit("other"))),
        item("warnings", F.when(k % 3 == 0, F.lit("careful"))), item("unknown", F.lit("x")),
    )
    all_items = F.when(k % 2 == 0, F.concat(items, F.array(item("Old Unit", F.lit("mg"))))).otherwise(items)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(all_items).alias("place", "s")).select("n_nationkey", "place", "s.*")
    return D.canonical_record(rows, "n_nationkey", ["kd_value", "unit"], "name", "value", "place", {"old_unit": "unit"})


@query(
    """WITH n AS (SELECT doc_id, md5(text) AS h FROM documents), o AS (SELECT * FROM n WHERE doc_id % 3 <> 1), f AS (SELECT * FROM n WHERE doc_id % 3 <> 2), same AS (SELECT o.doc_id AS old_id, f.doc_id AS new_id FROM o JOIN f USING (doc_id)),
 a AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS i FROM o WHERE doc_id NOT IN (SELECT old_id FROM same)), b AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS i FROM f WHERE doc_id NOT IN (SELECT new_id FROM same))
 SELECT old_id, new_id, 'source_key' AS method FROM same UNION ALL SELECT a.doc_id, b.doc_id, 'content' FROM a JOIN b USING (h, i)"""
)
def lineage_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh rows take over from old ones by source key, then by equal content. Fresh rows that could find none are left
    out beforehand, as they would stop the run."""
    n = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"), F.col("doc_id").alias("key"))
    old = n.where("doc_id % 3 <> 1").withColumnRenamed("doc_id", "old_id")
    fresh = n.where("doc_id % 3 <> 2").withColumnRenamed("doc_id", "new_id")
    rest = lambda d: d.where("key % 3 <> 0").withColumn("i", F.row_number().over(Window.partitionBy("h").orderBy("key")))
    partner = rest(fresh).join(rest(old).select("h", "i"), ["h", "i"]).select("new_id")
    fresh = fresh.where("key % 3 = 0").unionByName(fresh.join(partner, "new_id", "left_semi"))
    return M.refresh_lineage(old, fresh, ["key"], ["h"], "old_id", "new_id")
