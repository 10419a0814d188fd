"""Sharding by proportional stratified interleaving. DataFrame functions only.

Definition. Within each source the rows are shuffled (by a seeded hash of doc_id) and ranked; a row's place
is its fractional rank (rank + 1/2) / rows of the source. All rows, sorted by (place, source, rank), are cut
into shards whose counts differ by one at most (law `rows`). As every source is spread evenly over the line,
every stretch of it, and so every shard, holds the sources in the table's proportions.

Ranks come from range-dealt tables of slim rows (operators/tables.py): no task holds a source.

Edge cases. Very long texts: only their size and CRC leave the scan. Null text: size 8, CRC 0. Null source: a source of its own. Null or repeated doc_id: each row
gets a slot; equal rows may swap places. Fewer rows than shards: some shards are empty. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, group_key, hash60, ranked


def interleave(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "shard") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null), and source."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8
    crc = F.coalesce(F.crc32(F.encode(F.col(text_col), "UTF-8")), F.lit(0)).cast("long")
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), group_key(F.col(source_col)).alias("__key"), size.alias("__size"), crc.alias("__crc"), hash60(seed, F.col(id_col)).alias("__h"))
    rows = scratch.table(rows, "sizes")
    rows = ranked(rows, ["__key"], ["__h", "__id", "__size", "__crc"], "__rank", "__of", scratch, "sources")
    rows = scratch.table(rows.withColumn("__place", (2 * F.col("__rank") + 1) / (2 * F.col("__of"))), "places")
    line = ranked(rows, [], ["__place", "__key", "__rank"], "__at", "__all", scratch, "line")
    line = line.withColumn("__shard", F.expr(f"(__at * {shards}) div __all"))
    first = F.expr(f"(__shard * __all + {shards - 1}) div {shards}")
    return line.select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("__shard").cast("int").alias("shard"), (F.col("__at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("__source").alias("source"),
    )
