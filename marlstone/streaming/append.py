"""Resumable append: rows whose key is in the output already are skipped, whoever wrote them.

The checkpoint remembers which files are done; the anti-join on the output makes a batch that is run again
after a failure write nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_unseen(batch: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends the rows of a batch whose keys the table at path lacks; equal keys within the batch are written once."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(list(keys))
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(*keys).distinct(), list(keys), "left_anti")
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def resume_append(spark: SparkSession, source: str, schema, path: str, checkpoint: str, keys: Sequence[str], transform: Callable[[DataFrame], DataFrame] = lambda d: d, files_per_batch: int = 1000) -> StreamingQuery:
    """A file stream of parquet that appends what is new and ends when all files there are done."""
    rows = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source))
    return rows.writeStream.foreachBatch(lambda b, _: append_unseen(b, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: Sequence[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per event-time window with a watermark; works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
