"""A training corpus from `documents`: quality rules, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; `run` writes each stage's
rows to the shared folder and reads them again, so a lost executor costs at most a stage's tasks.

Edge cases. Null and empty texts, and texts of fewer than 50 words, fail the quality rules. Very long texts go through
whole; their ids are cut to pieces. Null doc_id: the row stays as long as its text is good and no copy of another.
Repeated rows: one stays. No labels of both kinds: the base rules decide alone. Empty table: no sequences, and every
stage keeps the columns. Extra columns of any name are kept up to the last stage, which returns sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import mixing, packing, quality, simhash
from marlstone.llm.common import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest (fitted on the labelled ones among docs) keep."""
    return quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (5-word shingles, Jaccard 0.8 or more), that with the least doc_id."""
    return simhash.one_of_each(docs, similarity=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights emits them."""
    return mixing.resample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences, each a power of two long, with their ids as binary, little-endian, 16 bits each."""
    return packing.pack(docs, with_ids="binary")


STAGES = [("quality rules", keep_good), ("simhash near-dedup", drop_copies), ("mixing to target weights", mix_sources), ("packing", pack_sequences)]

#: Fingerprints, the forest and the tokenizer have no SQL; tests/llm/test_pipeline.py has the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage{i}")
    return docs
