"""Intermediate tables in the shared folder, and positions in a total order without a task that holds a group."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []
_written: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a temporary one of this process, in local mode only:
    on a cluster each executor would write to its own disk, and readers would miss rows without an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="marlstone-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def _delete(path: str) -> None:
    context = SparkContext._active_spark_context
    if context is None or context._jsc is None:
        return
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _free() -> None:
    """Results may read their intermediate tables as long as the process lives; then these go."""
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session may be gone: then the folder's owner clears it
            return


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{scratch_root(spark)}/marlstone-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        path, writer = f"{self.path}/{name}", df.write.option("compression", "zstd")
        _written.add(self.path)
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Frees a table that no later plan reads."""
        _delete(f"{self.path}/{name}")


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder, which ends its lineage."""
    return Scratch(df.sparkSession).table(df, name)


def in_order(df: DataFrame, order: Sequence[str | Column], scratch: Scratch, name: str, parts: int = 0) -> DataFrame:
    """df as a written table, dealt by ranges of `order` and sorted within them, with `__slot` (the range's number)
    and `__slot_at` (the row's place in it). Spark draws the ranges from a bounded sample; a key with many rows is
    split as long as the later columns of `order` differ. parts: ranges at least (else as many as the session shuffles to)."""
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        ranges = df.repartitionByRange(parts, *order)
    else:
        ranges = df.repartitionByRange(*order)
    place = F.monotonically_increasing_id()
    rows = ranges.sortWithinPartitions(*order).withColumn("__slot_place", place)
    rows = rows.withColumns({"__slot": F.shiftright("__slot_place", 33), "__slot_at": F.col("__slot_place").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__slot_place")
    return scratch.table(rows, name)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], pos: str, total: str, scratch: Scratch, name: str, facts: Callable[[DataFrame], DataFrame] | None = None, parts: int = 0) -> DataFrame:
    """Adds each row's position (from 0) and the row count within its group, by `order`.

    facts: makes of the ordered rows a table with one row per group, whose columns are added by way of the counts. Rows cross one range
    shuffle; a window sees only (group, range) counts, of which there are as many as ranges and groups together.
    Columns of `group` must not be null.
    """
    rows, n, start = in_order(df, [*group, *order], scratch, name, parts), "__slot_n", "__slot_start"
    counts = rows.groupBy("__slot", *group).agg(F.count(F.lit(1)).alias(n), F.min("__slot_at").alias("__slot_first"))
    of = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum(n).over(of.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({start: before - F.col("__slot_first"), total: F.sum(n).over(of)}).drop(n, "__slot_first")
    if facts is not None:
        counts = counts.join(facts(rows), list(group))
    rows = rows.join(counts, ["__slot", *group]).withColumn(pos, (F.col("__slot_at") + F.col(start)).cast("long"))
    return rows.drop("__slot", "__slot_at", start)
