"""Splits and support on the driver's tables: suppliers and customers stand for studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits as S
from .registry import Registry, table

plans = Registry()
query = plans.query

_TEST = "(SELECT c_custkey FROM customer ORDER BY md5('split|' || c_custkey) LIMIT (SELECT ceil(round(0.2 * count(*), 9))::BIGINT FROM customer))"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.group_holdout(table(spark, sf_dir, "customer"), "c_custkey", 0.2)


@query(f"SELECT c_custkey, CASE WHEN c_custkey IN {_TEST} THEN 'test' ELSE 'training' END AS split FROM customer")
def group_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded share of the groups, whole."""
    return _split(spark, sf_dir).select("c_custkey", "split")


@query(f"""SELECT CASE WHEN c_custkey IN {_TEST} THEN 'test' ELSE 'training' END AS split, count(*) AS rows, count(DISTINCT c_nationkey) AS n_c_nationkey, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd FROM customer GROUP BY 1""")
def split_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, units and target by side."""
    return S.split_diagnostics(_split(spark, sf_dir), ["c_nationkey"], "c_acctbal").withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


@query(f"""SELECT split, count(*) AS members, sum(('0x' || substr(md5(c_custkey::VARCHAR), 1, 15))::BIGINT::DECIMAL(38, 0))::VARCHAR AS digest FROM (SELECT c_custkey, CASE WHEN c_custkey IN {_TEST} THEN 'test' ELSE 'training' END AS split FROM customer) GROUP BY 1""")
def membership_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digests of the sides' members."""
    return S.membership_hash(_split(spark, sf_dir), "split", "c_custkey")


@query(f"""SELECT o_custkey FROM (SELECT o_custkey, CASE WHEN md5('split|' || o_orderkey) < '8' THEN 'test' ELSE 'training' END AS split FROM orders) GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def crossing_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """units on both sides of a split by row."""
    o = table(spark, sf_dir, "orders").withColumn("split", F.when(S.draw("split", F.col("o_orderkey")) < "8", "test").otherwise("training"))
    return S.membership_violations(o, "o_custkey").select("o_custkey")


@query("""WITH RECURSIVE g AS (SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, md5(o_custkey::VARCHAR)) AS i FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)),
 r AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, NULL::BIGINT AS k, 0::BIGINT AS f UNION ALL SELECT g.i, list_transform(load, lambda x, j: CASE WHEN j = list_position(load, list_min(load)) THEN x + n ELSE x END), o_custkey, list_position(load, list_min(load)) - 1 FROM r JOIN g ON g.i = r.i + 1)
 SELECT k AS o_custkey, f::INT AS fold FROM r WHERE i > 0""")
def balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest group first to the lightest fold."""
    return S.balanced_folds(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", 5).distinct()


@query()
def size_matched_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups whose row total comes closest to the fraction."""
    d = S.size_matched_holdout(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", 0.2)
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_custkey").alias("groups"))


@query()
def pair_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs held out as long as both components stay in training."""
    d = S.pair_holdout(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag"), "l_suppkey", "l_returnflag", 0.2)
    return d.groupBy("split").agg(F.count_distinct("l_suppkey", "l_returnflag").alias("pairs"), F.count_distinct("l_suppkey").alias("suppliers"))


@query()
def evidence_balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds whose strata are evened out by single moves."""
    s = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    return S.evidence_balanced_folds(s, "c_nationkey", "c_mktsegment", 4).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("c_nationkey").alias("groups"))


@query("""SELECT * FROM (VALUES ('l_quantity', 'selected', NULL), ('l_extendedprice', 'selected', NULL), ('l_discount', 'selected', NULL), ('l_orderkey', 'dropped', 'identifier or leakage'), ('double_quantity', 'dropped', 'correlated with l_quantity'), ('one', 'dropped', 'too few values'), ('sparse', 'dropped', 'too few rows'), ('nowhere', 'dropped', 'missing column')) t(feature, verdict, reason)""")
def feature_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reasoned verdict per candidate, the first failing rule's."""
    l = table(spark, sf_dir, "lineitem").withColumns({"double_quantity": F.col("l_quantity") * 2, "one": F.lit(1), "sparse": F.when(F.col("l_orderkey") < 0, 1.0)})
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey", "double_quantity", "one", "sparse", "nowhere"]
    return S.screen_features(l, names, "l_suppkey", identifiers=["l_orderkey"])


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_size < lo OR p_size > hi THEN 'p_size' END) AS out_of_range, concat_ws(',', CASE WHEN kind NOT IN (SELECT p_type FROM part WHERE p_brand < 'Brand#2') THEN 'p_type' END) AS unseen, concat_ws(',', CASE WHEN kind IS NULL THEN 'p_type' END) AS absent
 FROM (SELECT *, CASE WHEN p_partkey % 10 <> 0 THEN p_type END AS kind FROM part WHERE p_brand >= 'Brand#2'), (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part WHERE p_brand < 'Brand#2' AND p_size BETWEEN 5 AND 45)""".replace("p_type FROM part WHERE p_brand < 'Brand#2'", "p_type FROM part WHERE p_brand < 'Brand#2' AND p_size BETWEEN 5 AND 45"))
def input_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values out of the training range, unseen levels, missing features."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    q = p.where("p_brand >= 'Brand#2'").withColumn("p_type", F.when(F.col("p_partkey") % 10 != 0, F.col("p_type")))
    out = S.range_support(p.where("p_brand < 'Brand#2' AND p_size BETWEEN 5 AND 45"), q, ["p_size"], ["p_type"])
    return out.select("p_partkey", *[F.array_join(c, ",").alias(c) for c in ("out_of_range", "unseen", "absent")])


@query("""SELECT p_partkey, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1 AS present, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1 >= 2 AS eligible FROM (SELECT p_partkey, CASE WHEN p_size > 20 THEN 1 END AS a, CASE WHEN p_retailprice > 1000 THEN 1 END AS b FROM part)""")
def product_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enough features are there."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 20, 1).alias("a"), F.when(F.col("p_retailprice") > 1000, 1).alias("b"), "p_size")
    return S.eligible(p, ["a", "b", "p_size"], 2).select("p_partkey", "present", "eligible")


@query("""WITH t AS (SELECT p_type, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS s FROM part), k AS (SELECT p_type FROM part GROUP BY 1 HAVING count(*) >= 60)
 SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_size END, (SELECT quantile_cont(s, 0.5) FROM t))::DOUBLE AS s, CASE WHEN p_type IN (SELECT p_type FROM k) THEN p_type ELSE 'infrequent' END AS p_type FROM part""")
def design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians for missing numbers, rare levels grouped."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("double")).alias("s"), "p_type")
    return S.design_matrix(p, p, ["s"], ["p_type"], 60)


@query()
def density_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dissimilarity of every row by a kernel density."""
    p = table(spark, sf_dir, "part")
    return S.density_support(p, p, "p_partkey", ["p_size", "p_retailprice"]).withColumn("dissimilarity", F.round("dissimilarity", 9))


@query("""SELECT vec_id, neighbour, round(s, 6) AS similarity FROM (SELECT a.vec_id, b.vec_id AS neighbour, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE r = 1""")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar other vector. Queries are the rows whose id is divisible by 20, against all rows."""
    e = table(spark, sf_dir, "embeddings")
    return S.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding").select("vec_id", "neighbour", F.round("similarity", 6).alias("similarity"))


@query("""SELECT * FROM (VALUES ('price', '', 'corr__001', 'price', 1.0::DOUBLE, false), ('size', '', NULL, 'size', NULL, false), ('half_price', '', 'corr__001', 'price', 1.0::DOUBLE, true), ('some_price', '', 'corr__001', 'price', 1.0::DOUBLE, true)) t(feature, family, component, selected, strength, dropped)""")
def correlated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that correlations connect, and the one that stays: least missing, then widest."""
    price = F.col("p_retailprice").cast("double")
    p = table(spark, sf_dir, "part").select(price.alias("price"), F.col("p_size").alias("size"), (price / 2).alias("half_price"), F.when(F.col("p_partkey") % 3 != 0, price * 5).alias("some_price"))
    return S.prune_components(p, ["price", "size", "half_price", "some_price"]).withColumn("strength", F.round("strength", 9))
