"""Readers. Bad input becomes columns to filter on, not exceptions in the middle of a scan."""

from __future__ import annotations

import csv
import os
import re
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _transient(error: BaseException) -> bool:
    """Whether an error is one of input and output that may pass: the system's, or one that Spark's file system threw. A
    missing file or folder, and errors of analysis, don't pass."""
    if isinstance(error, FileNotFoundError) or "PATH_NOT_FOUND" in str(error) or "FileNotFoundException" in str(error):
        return False
    return isinstance(error, OSError) or any(x in str(error) for x in ("java.io.IOException", "java.net.Socket", "java.net.ConnectException", "TimeoutException"))


def with_retry(read: Callable[[], DataFrame], attempts: int = 4, wait: float = 1.0) -> DataFrame:
    """Retries transient errors of listing files and reading their schema, which is when a scan is planned, with linear
    back-off. What fails while rows are read, Spark's tasks retry themselves."""
    for i in range(1, attempts + 1):
        try:
            return read()
        except Exception as e:
            if i == attempts or not _transient(e):
                raise
            time.sleep(wait * i)
    raise AssertionError


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sheet: str | int = 0) -> DataFrame:
    """By suffix: .csv (blank cells stay empty text, all columns are text unless a schema is given), .parquet, .json and
    .jsonl, .orc; .xlsx in the driver, where a reader for it is installed."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        reader = spark.read.option("header", True).option("nullValue", None).option("emptyValue", "").option("multiLine", True).option("escape", '"')
        return with_retry(lambda: (reader.schema(schema) if schema else reader).csv(path).na.fill(""))
    if kind in (".xlsx", ".xls"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, keep_default_na=False, dtype=str))
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in (".json", ".jsonl"):
        return with_retry(lambda: reader.json(path))
    return with_retry(lambda: reader.orc(path) if kind == ".orc" else reader.parquet(path))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and the lines that don't, as (path, line)."""
    kinds = T.StructType.fromDDL(schema)
    raw = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line")).where("trim(line) <> ''")
    raw = raw.withColumn("r", F.from_json("line", T.StructType(list(kinds.fields)).add("__bad", T.StringType()), {"columnNameOfCorruptRecord": "__bad"}))
    return raw.where("r.__bad is null").select(*[F.col(f"r.{c}") for c in kinds.names]), raw.where("r.__bad is not null").select("path", "line")


ARTIFACT = "status string, outputs array<struct<study_folder string, file_type string, chunk_id string, extracted_data map<string, struct<records array<map<string, string>>>>>>"


def read_artifacts(spark: SparkSession, path: str, tasks: Sequence[str]) -> DataFrame:
    """Nested artifacts (one JSON document per file) as rows: study, task, file_type, chunk_id, position, record, path.

    Folders without artifacts and documents that failed or don't parse have no rows."""
    raw = spark.read.schema(ARTIFACT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return flatten_artifacts(raw.withColumn("path", F.input_file_name()), tasks)


def flatten_artifacts(raw: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """raw: ARTIFACT and a path."""
    out = raw.where(F.coalesce("status", F.lit("failed")) == "ok").select("path", F.explode("outputs").alias("o"))
    task = F.explode(F.array(*map(F.lit, tasks))).alias("task")
    out = out.select("path", "o", task).select("path", "task", "o.study_folder", "o.file_type", "o.chunk_id", F.col("o.extracted_data")[F.col("task")]["records"].alias("r"))
    return out.select(F.col("study_folder").alias("study"), "task", "file_type", "chunk_id", F.posexplode("r").alias("position", "record"), "path")


def _size(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file or folder where Spark reads it; None if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(at).getLength() if fs.exists(at) else None


def checked_rows(raw: DataFrame, schema: str, required: Sequence[str], checks: Mapping[str, Column] | None = None, ragged: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of text -> (good rows, typed; bad rows with `errors`). Ragged and ill-typed rows, blank required cells, and rows
    that miss a check are bad; a number has to be finite."""
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(schema)}
    header = [c for c in raw.columns if c != "__bad"]
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    typed = {c: F.col(c).try_cast(k) for c, k in kinds.items() if c in header}
    typed = {c: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else v for c, v in typed.items()}
    errors = [F.when(ragged, "wrong number of cells")] if ragged is not None else []
    errors += [F.when(blank(F.col(c)), f"{c} is blank") for c in required]
    errors += [F.when(~blank(F.col(c)) & v.isNull(), f"{c} is no {kinds[c].simpleString()}") for c, v in typed.items()]
    errors += [F.when(~F.coalesce(ok, F.lit(False)), label) for label, ok in (checks or {}).items()]
    flagged = raw.withColumn("errors", F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>"))
    good = flagged.where(F.size("errors") == 0).select(*[v.alias(c) for c, v in typed.items()])
    return good, flagged.where(F.size("errors") > 0).select(*header, "errors")


def _checked_header(header: Sequence[str], required: Sequence[str]) -> None:
    if repeated := sorted({h for h in header if list(header).count(h) > 1}):
        raise ValueError(f"repeated columns: {', '.join(repeated)}")
    if missing := [c for c in required if c not in header]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def checked_csv(spark: SparkSession, path: str, schema: str, required: Sequence[str], checks: Mapping[str, Column] | None = None, most_rows: int | None = None, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Strict import of a CSV file: (good rows, bad rows with `errors`), see checked_rows. Repeated or missing headers (quoted
    ones may hold commas), and files beyond `most_rows` or `most_bytes`, fail at once."""
    if most_bytes is not None and (_size(spark, path) or 0) > most_bytes:
        raise ValueError(f"more than {most_bytes} bytes")
    first = spark.read.text(path).first()
    header = [h.strip() for h in next(csv.reader([first[0].lstrip("\ufeff")]))] if first else []
    _checked_header(header, required)
    text = T.StructType([T.StructField(h, T.StringType()) for h in header]).add("__bad", T.StringType())
    raw = spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").option("escape", '"').csv(path).cache()
    if most_rows is not None and raw.count() > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    return checked_rows(raw, schema, required, checks, F.col("__bad").isNotNull())


def read_scenarios(spark: SparkSession, path: str, schema: str, required: Sequence[str], aliases: Mapping[str, Sequence[str]] | None = None, checks: Mapping[str, Column] | None = None, most_rows: int = 10_000, most_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """Scenarios of a CSV file or a workbook's first sheet: (good, bad with `errors`), with `row` (from 1) to tell them by.

    Headers are known by their folded names or `aliases` (name: other names); unknown ones are an error, as a misspelt
    condition would else be left out without a word. Scenarios are typed by people: their number is bounded."""
    if (_size(spark, path) or 0) > most_bytes:
        raise ValueError(f"more than {most_bytes} bytes")
    names = {f.name for f in T.StructType.fromDDL(schema)}
    fold = lambda h: "".join(ch for ch in h.lower() if ch.isalnum())
    known = {fold(a): n for n in names for a in (n, *(aliases or {}).get(n, ()))}
    df = read_table(spark, path)
    if unknown := [c for c in df.columns if fold(c) not in known]:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    header = [known[fold(c)] for c in df.columns]
    _checked_header(header, required)
    rows = [tuple(r) for r in df.limit(most_rows + 1).collect()]
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    text = T.StructType([T.StructField(h, T.StringType()) for h in header]).add("row", T.StringType())
    raw = spark.createDataFrame([(*[None if v is None else str(v) for v in r], str(i)) for i, r in enumerate(rows, 1)], text)
    return checked_rows(raw, f"{schema}, row int", required, checks)


def collect_runs(spark: SparkSession, runs: DataFrame, folder: str, filename: str, status: str = "status", done: str = "completed", base: str | None = None) -> DataFrame:
    """The same CSV of every finished run, united by name, with the run's metadata (`run_<column>` where names clash).

    Missing and empty files are skipped. A run whose folder is gone is looked for below `base` by its folder's last name,
    as batches get moved. A file may be a folder of parts. Runs with the same header are one scan; runs has a row per run, which the driver reads."""
    by_header: dict[tuple, list[str]] = {}
    found: list[tuple[str, int]] = []
    listed = runs.where(F.col(status) == done).collect()
    for i, run in enumerate(listed):
        places = [run[folder], *([f"{base}/{str(run[folder]).rstrip('/').rpartition('/')[2]}"] if base else [])]
        path = next((f"{p}/{filename}" for p in places if p and _size(spark, f"{p}/{filename}")), None)
        if path and (first := spark.read.text(path).first()):
            by_header.setdefault(tuple(next(csv.reader([first[0]]))), []).append(path)
            found.append((path, i))
    meta = [c for c in runs.columns if c not in (folder, status)]
    out = None
    for header, paths in by_header.items():
        text = T.StructType([T.StructField(h, T.StringType()) for h in header])
        rows = spark.read.schema(text).option("header", True).csv(paths).withColumn("__at", F.regexp_replace(F.regexp_replace(F.input_file_name(), "^[a-z]+:/*", "/"), "/part-[^/]*$", ""))
        table = spark.createDataFrame([(re.sub("^[a-z]+:/*", "/", p), *[listed[i][c] for c in meta]) for p, i in found if p in paths], T.StructType([T.StructField("__at", T.StringType()), *[T.StructField(f"run_{c}" if c in header else c, runs.schema[c].dataType) for c in meta]]))
        rows = rows.join(table, "__at").drop("__at")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "run_id string")


def escaped_text(c: Column) -> Column:
    """Text that no spreadsheet takes for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
