"""Window, ordering, set and reshape operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit as D
from ..operators import graph, shape
from ..operators import window as W
from .registry import Registry, table

plans = Registry()
query = plans.query


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, fam ORDER BY c_acctbal DESC, c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM (SELECT *, coalesce(nullif(trim(CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END), ''), 'unclassified') AS fam FROM customer)),
 p AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n > 8 AND i > 2, c_acctbal DESC, c_custkey) AS place FROM r) SELECT c_nationkey, c_custkey, place FROM p WHERE place <= 8""")
def diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two of a family in score order, then backfill."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 11 == 0, "").otherwise(F.col("c_mktsegment")).alias("family"))
    return W.diverse_top(c, ["c_nationkey"], "family", "c_acctbal", "c_custkey", 8).select("c_nationkey", "c_custkey", "place")


@query("""SELECT s_nationkey, count(*) AS n, count(*) FILTER (WHERE m - s_acctbal <= 500) AS close FROM (SELECT *, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS m FROM supplier) GROUP BY 1""")
def gap_to_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the margin can't tell from the best."""
    s = table(spark, sf_dir, "supplier").withColumn("close", W.gap_to_top("s_acctbal", ["s_nationkey"], 500.0))
    return s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("close").alias("close"))


@query("""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'unclear' WHEN mx = mn THEN 'single' WHEN abs(mx - t) <= 1e-9 THEN 'last' ELSE 'intermediate' END AS label
 FROM (SELECT *, max(t) OVER (PARTITION BY user_id, d) AS mx, min(t) OVER (PARTITION BY user_id, d) AS mn FROM (SELECT event_id, user_id, ts::DATE AS d, CASE WHEN event_id % 13 <> 0 THEN epoch_us(ts) // 1000000 / 3600.0::DOUBLE END AS t FROM events))""")
def last_timepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single, last, intermediate or unclear time of a group."""
    t = F.when(F.col("event_id") % 13 != 0, F.floor(F.unix_micros("ts") / 1000000).cast("double") / 3600.0)
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", F.to_date("ts").alias("d"), t.alias("t"))
    return e.select("event_id", W.last_time_label("t", ["user_id", "d"]).alias("label"))


@query("""WITH w AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) < 50 AS s FROM conversations), g AS (SELECT *, (NOT s OR NOT coalesce(lag(s) OVER o, false) OR lag(role) OVER o IS DISTINCT FROM role)::INT AS st FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
 r AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM g) SELECT conv_id, run, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS pieces FROM r GROUP BY ALL""")
def merge_short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent short texts of one section joined."""
    return W.merge_short_runs(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "text", 50)


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS p FROM orders), x AS (SELECT o_custkey, o_orderstatus, min(p) AS lo, max(p) AS hi FROM a WHERE p IS NOT NULL GROUP BY ALL), y AS (SELECT o_custkey, min(p) AS lo2, max(p) AS hi2 FROM a WHERE p IS NOT NULL GROUP BY ALL)
 SELECT o_orderkey, coalesce(p, CASE WHEN x.lo = x.hi THEN x.lo WHEN x.lo IS NULL AND lo2 = hi2 THEN lo2 END) AS p, CASE WHEN p IS NULL AND x.lo = x.hi THEN 0 WHEN p IS NULL AND x.lo IS NULL AND lo2 = hi2 THEN 1 END AS p_from FROM a LEFT JOIN x USING (o_custkey, o_orderstatus) LEFT JOIN y USING (o_custkey)""")
def borrow_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values take what the narrowest scope with evidence agrees on."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("p"))
    return W.borrow_unanimous(o, "p", [["o_custkey", "o_orderstatus"], ["o_custkey"]]).select("o_orderkey", "p", "p_from")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), b AS (SELECT conv_id, i, turn, 0::BIGINT AS batch, length(text) AS total FROM t WHERE i = 1
 UNION ALL SELECT t.conv_id, t.i, t.turn, CASE WHEN b.total + length(t.text) > 1500 AND b.total > 0 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.total + length(t.text) > 1500 AND b.total > 0 THEN length(t.text) ELSE b.total + length(t.text) END FROM b JOIN t ON t.conv_id = b.conv_id AND t.i = b.i + 1)
 SELECT conv_id, turn, batch FROM b""")
def budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy batches under a character budget. One conversation's sizes fit an array; its texts need not."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.length("text").cast("long").alias("n")).alias("s"))
    c = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    c = c.withColumn("b", W.batches(F.transform("s", lambda x: x.n), 1500))
    return c.select("conv_id", F.explode(F.arrays_zip(F.transform("s", lambda x: x.turn).alias("turn"), F.col("b").alias("batch"))).alias("z")).select("conv_id", "z.turn", "z.batch")


@query("""WITH l AS (SELECT DISTINCT p_brand, unnest(string_split(p_type, ' ')) AS w FROM part WHERE p_size > 20) SELECT p_partkey, CASE WHEN p_size > 20 THEN (SELECT string_agg(w, '; ' ORDER BY w) FROM l WHERE l.p_brand = part.p_brand) ELSE p_type END AS labels FROM part""")
def pool_identity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sets pooled over a shared identity and written back to the rows that qualify."""
    p = D.pool_tokens(table(spark, sf_dir, "part"), ["p_brand"], F.split("p_type", " "), F.col("p_size") > 20, "pooled")
    return p.select("p_partkey", F.coalesce("pooled", "p_type").alias("labels"))


@query("""SELECT l_orderkey, l_linenumber, feature, v AS value, place FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY abs(v) DESC, feature) AS place FROM (SELECT rid, l_orderkey, l_linenumber, unnest(['quantity', 'discount', 'tax']) AS feature, unnest([l_quantity - 25, l_discount * 300 - 15, l_tax * 300 - 12]) AS v FROM (SELECT *, row_number() OVER () AS rid FROM lineitem))) WHERE place <= 2""")
def top_by_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest values by magnitude of each row; the row is sorted in place, nothing is shuffled."""
    parts = (("quantity", F.col("l_quantity") - 25), ("discount", F.col("l_discount") * 300 - 15), ("tax", F.col("l_tax") * 300 - 12))
    return shape.top_magnitudes(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], dict(parts), 2)


@query("""SELECT o_orderpriority, o_totalprice, o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100""")
def sort_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed directions with an explicit tiebreak, the first hundred (a top-k report)."""
    top = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")).cast("long"))  # 100 rows


@query("""WITH e AS (SELECT c_mktsegment, list_distinct([quantile_cont(v, 0), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75), quantile_cont(v, 1)]) AS e FROM (SELECT c_mktsegment, greatest(c_acctbal, 0) AS v FROM customer) GROUP BY 1)
 SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN greatest(len(list_filter(e2, lambda x: x < v)) - 1, 0)::INT END AS bin FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 9 <> 0 THEN greatest(c_acctbal, 0) END AS v FROM customer)
 JOIN (SELECT c_mktsegment, list_distinct([quantile_cont(v, 0), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75), quantile_cont(v, 1)]) AS e2 FROM (SELECT c_mktsegment, CASE WHEN c_custkey % 9 <> 0 THEN greatest(c_acctbal, 0) END AS v FROM customer) GROUP BY 1) USING (c_mktsegment)""")
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile bins per group, equal edges dropped, missing values without a bin."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 9 != 0, F.greatest("c_acctbal", F.lit(0.0))).alias("v"))
    return W.quantile_bins(c, "v", 4, ["c_mktsegment"]).select("c_custkey", "bin")


@query("""SELECT s_suppkey AS k, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, A10: union by name; columns that one side lacks are null."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("""SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 1""")
def keys_in_all_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys found in every run, less those of another set."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_partkey").agg(F.count_distinct("l_returnflag").alias("n")).where("n = 3").select("l_partkey").subtract(l.where("l_quantity = 1").select("l_partkey"))


@query("""SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'purchase') AS purchase, max(value) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1""")
def method_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column per method value."""
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.max("value"))


@query("""SELECT event_id, (props ->> 'k')::BIGINT AS k FROM events""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON text; text that is no JSON gives null."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'b' || p_brand AS a, 't' || p_type || (p_size // 10) AS b FROM part WHERE p_size > 45), s AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
 r AS (SELECT u, u AS m FROM s UNION SELECT s.v, r.m FROM r JOIN s ON s.u = r.u WHERE r.m < s.v) SELECT u AS node, min(m) AS component FROM r GROUP BY 1""")
def corr_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components; each node has its component's least member."""
    e = table(spark, sf_dir, "part").where("p_size > 45").select(F.concat(F.lit("b"), "p_brand").alias("u"), F.concat(F.lit("t"), "p_type", F.expr("p_size div 10").cast("string")).alias("v"))
    return graph.components(e).select("node", "component")


@query("""SELECT n_regionkey, n_nationkey, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def left_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that keep keys without rows."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"))
    n = table(spark, sf_dir, "nation")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").select("n_regionkey", "n_nationkey", F.coalesce("k", F.lit(0)).alias("customers"))


@query()
def greedy_set_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that cover all parts that any of them has, the largest gain first, ties by key."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("set"), F.col("l_partkey").alias("element")).distinct()
    return graph.set_cover(pairs)


@query("""SELECT column_name AS name, row_number() OVER (ORDER BY CASE WHEN column_name = 'l_shipdate' THEN 0 WHEN starts_with(column_name, 'l_ex') THEN 1 WHEN starts_with(column_name, 'l_q') OR starts_with(column_name, 'l_disc') THEN 2 ELSE 3 END, CASE WHEN starts_with(column_name, 'l_disc') THEN 1 ELSE 0 END, i) - 1 AS place
 FROM (SELECT unnest(['l_orderkey', 'l_partkey', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_shipdate']) AS column_name, unnest(range(6)) AS i)""")
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by families: pinned ones first, then prefixes in order, then the rest as they come."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    names = shape.ordered_columns(l, ["l_ex*", "l_q*", "l_disc*"], ["l_shipdate"]).columns
    return spark.createDataFrame(list(enumerate(names)), "place long, name string").select("name", "place")
