"""Writers: projections of one table, checked bundles."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_projections(df: DataFrame, path: str, projections: Mapping[str, tuple[Sequence[str], str | None]], mode: str = "overwrite") -> None:
    """Each (columns, condition) of one table in a folder of its own; columns that the table lacks are left out."""
    for name, (columns, condition) in projections.items():
        part = df.where(condition) if condition else df
        part.select(*[c for c in columns if c in df.columns]).write.mode(mode).parquet(f"{path}/{name}")


def _text(spark: SparkSession, path: str, body: str | None = None) -> str:
    """Reads a small text file where the tables are, or writes it: to a temporary file that then replaces the target in
    one step, so that at any time either the old or the new text is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if body is None:
        s = fs.open(p)
        return bytes(s.readAllBytes()).decode()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    t = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    s = fs.create(t, True)
    s.write(bytearray(body.encode()))
    s.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(t, p, options)
    return body


BUNDLE = 1


def write_bundle(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], about: Mapping[str, object]) -> dict:
    """Tables and a manifest with their row counts and checksums; the manifest comes last, so a part bundle has none."""
    manifest = {"version": BUNDLE, "about": dict(about), "tables": {}}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        manifest["tables"][name] = checksum(spark.read.parquet(f"{path}/{name}"))
    _text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def checksum(df: DataFrame) -> dict:
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).cast("decimal(20,0)")
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0))).first()
    return {"rows": n, "sum": str(total)}


def read_bundle(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest and its tables; another version or a changed table is an error."""
    manifest = json.loads(_text(spark, f"{path}/manifest.json"))
    if manifest["version"] != BUNDLE:
        raise ValueError(f"bundle version {manifest['version']}, not {BUNDLE}")
    tables = {}
    for name, want in manifest["tables"].items():
        tables[name] = spark.read.parquet(f"{path}/{name}")
        if (got := checksum(tables[name])) != want:
            raise ValueError(f"table {name} has changed: {got} instead of {want}")
    return manifest, tables
