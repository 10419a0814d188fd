"""Reading, writing and resuming, as queries on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udfs import with_identity_key
from ..operators.tables import scratch_root
from ..sources import readers, writers
from ..streaming import append
from .registry import Registry, table

plans = Registry()
query = plans.query


def _folder(df: DataFrame) -> str:
    """A new folder in the session's checkpoint folder, or in this process's temporary one."""
    return f"{scratch_root(df.sparkSession)}/marlstone-{uuid.uuid4().hex}"


@query("""SELECT event_id, user_id, event_type, value FROM events""")
def resumable_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream is stopped after part of its files and resumed with overlapping ones; every row is there once."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    at = _folder(e)
    for part in (e.where("event_id % 3 <> 0"), e.where("event_id % 3 <> 1")):
        part.write.mode("append").parquet(f"{at}/in")
        append.resume_append(spark, f"{at}/in", e.schema, f"{at}/out", f"{at}/state", ["event_id"]).awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{at}/out")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: event-time windows."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = append.windowed_counts(e, "ts", ["event_type"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_acctbal::VARCHAR AS c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by suffix; blank cells stay empty text."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    at = f"{_folder(c)}/customer.csv"
    c.write.option("header", True).option("emptyValue", "").csv(at)
    return readers.read_table(spark, at)


@query("""SELECT 'study' || s_nationkey AS study, 'records' AS task, s_name AS chunk_id, 0 AS position, s_suppkey::VARCHAR AS id FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT 'study' || s_nationkey, 'records', s_name, 1, (s_suppkey + 1)::VARCHAR FROM supplier WHERE s_suppkey % 4 <> 0""")
def artifact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested artifacts flattened with their lineage; failed ones have no rows."""
    s, rec = table(spark, sf_dir, "supplier"), lambda v: F.create_map(F.lit("id"), v.cast("string"))
    records = F.struct(F.array(rec(F.col("s_suppkey")), rec(F.col("s_suppkey") + 1)).alias("records"))
    output = F.struct(F.concat(F.lit("study"), F.col("s_nationkey").cast("string")).alias("study_folder"), F.lit("table").alias("file_type"), F.col("s_name").alias("chunk_id"), F.create_map(F.lit("records"), records).alias("extracted_data"))
    at = _folder(s)
    s.select(F.when(F.col("s_suppkey") % 4 != 0, "ok").otherwise("failed").alias("status"), F.array(output).alias("outputs")).write.json(at)
    lines = spark.read.schema(readers.ARTIFACT).json(at).withColumn("path", F.lit(at))
    found = readers.flatten_artifacts(lines, ["records", "none"])
    return found.select("study", "task", "chunk_id", "position", F.col("record")["id"].alias("id"))


@query("""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || CASE WHEN p_partkey % 3 = 0 THEN 'µ2'.replace('µ', 'μ') ELSE '' END AS key FROM part""")
def unicode_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: identity keys of compatibility forms; ASCII rows stay in the engine."""
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " µ²").otherwise(""))
    return with_identity_key(table(spark, sf_dir, "part").select("p_partkey", name.alias("n")), "n", "key").select("p_partkey", "key")


@query("""SELECT 'all' AS part, count(*) AS n FROM orders UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O'""")
def projections_and_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections of one table, and a bundle whose manifest is checked on reading."""
    o = table(spark, sf_dir, "orders")
    at = _folder(o)
    writers.write_projections(o, at, {"all": (o.columns, None), "open": (["o_orderkey", "nowhere"], "o_orderstatus = 'O'")})
    writers.write_bundle(spark, f"{at}/bundle", {k: spark.read.parquet(f"{at}/{k}") for k in ("all", "open")}, {"of": "orders"})
    _, tables = writers.read_bundle(spark, f"{at}/bundle")
    return tables["all"].agg(F.lit("all").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(tables["open"].agg(F.lit("open").alias("part"), F.count(F.lit(1)).alias("n")))


@query("""SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= 0 AND s_suppkey % 5 <> 0""")
def checked_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: strict CSV import; rows with blank required cells or failed checks stay out. Text is escaped against formulas."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", readers.escaped_text(F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("=x"), "s_name"))).alias("s_name"), "s_acctbal")
    at = f"{_folder(s)}/s.csv"
    s.write.option("header", True).csv(at)
    good, _ = readers.checked_csv(spark, at, "s_suppkey bigint, s_name string, s_acctbal double", ["s_name"], {"negative": F.col("s_acctbal").try_cast("double") >= 0, "formula": F.col("s_name").startswith("'=")})
    return good.select("s_suppkey", "s_acctbal")


@query("""SELECT r_regionkey AS run_id, n_nationkey::VARCHAR AS n_nationkey, n_regionkey::VARCHAR AS n_regionkey, r_name AS run_n_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey <> 2""")
def run_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the same CSV of every finished run, with the run's metadata; clashing names get a prefix."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    at = _folder(n)
    runs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("run_id"), F.concat(F.lit(f"{at}/"), F.col("r_regionkey").cast("string")).alias("dir"), F.when(F.col("r_regionkey") == 2, "failed").otherwise("completed").alias("status"), F.col("r_name").alias("n_regionkey"))
    for r in runs.collect():  # five runs
        n.where(F.col("n_regionkey") == r["run_id"]).write.option("header", True).csv(f"{r['dir']}/m.csv")
    return readers.collect_runs(spark, runs, "dir", "m.csv")
