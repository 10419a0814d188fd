"""The pipeline's stages against plain readings, each on its own input; queries against their SQL."""

import array
import glob
import os
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from marlstone.llm import katz, mixing, packing, quality, queries, simhash

from .test_near_copies import plain_kept

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        old, new = before.collect(), docs.collect()
        if i == 3:
            assert sorted(map(str, docs.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(str, packing.pack(before).select("doc_id", "start", "length", "ids_crc32").collect()))
            assert sum(r["length"] for r in new) == sum(r["doc_tokens"] for r in new if r["start"] == 0)
            for r in new:
                ids = array.array("H", bytes(r["ids"]))
                assert len(ids) == r["length"] and zlib.crc32(array.array("I", ids).tobytes()) == r["ids_crc32"]
            break
        assert docs.columns == columns and {tuple(r) for r in new} <= {tuple(r) for r in old}
        ids = Counter(r["doc_id"] for r in new)
        if i == 0:
            kept = {r.doc_id for r in quality.judge(before, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
            assert set(ids) == kept and len(kept) < len(old)
        elif i == 1:  # 5 words and a similarity of 0.8, as near-duplicate stages take; 4 words and 4 bits are op1's contract
            assert ids == Counter(plain_kept(sorted((r["doc_id"], r["text"]) for r in old)))
        else:
            taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(before).collect()}
            assert all(ids[k] * size == t for k, (t, size) in taken.items() if size)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "mixing to target weights", "packing"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df, wanted = queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_whole_table(spark, name):
    source = "conversations" if name == "op4_chat" else "documents"
    rows = queries.queries()[name](spark, SF)
    many = spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert rows.count() >= many


def test_extra_columns_and_reruns(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    clash = df.withColumnsRenamed({"n_chars": "fingerprint", "lang": "size"})
    for f in (simhash.near_duplicates, packing.pack, mixing.mix, katz.scores):
        a, b = (sorted(map(str, f(d).collect())) for d in (df, clash.repartition(3)))
        if f is katz.scores:  # sums of a document's logarithms are taken in token order, alike in every run
            assert a == b
        assert a == b
