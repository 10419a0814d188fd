"""Near copies by the Jaccard similarity of 5-word shingle sets: operator 1 where a similarity is asked for.

Definition. Words as in words.py; a text's set holds the XXH64 (seed 42) of its 5-word shingles, of the whole
sequence where there are fewer words. Two texts are near copies if their sets' Jaccard similarity is LEAST or more;
texts without words are copies of each other. A component is all that near copies connect.

Search. Texts have SimHash fingerprints over the same shingles, and what simhash.py's vantage-point trees connect within
BITS bits shares a key. Most texts at similarity 0.8 differ in more bits, too far for the trees (figures in the README);
so that none of them is lost, MinHash gives BANDS further keys of ROWS minima each: a pair at similarity s shares none of
these with probability (1 - s ** ROWS) ** BANDS, 3e-6 at 0.8. All that share a key are compared exactly. Texts that keys
connect are a cluster; equal sets enter once.

Clusters of up to MOST texts meet in one task each, which compares their sets exactly: what is within reach of a text
joins it, and only texts that have not joined are compared further, so a group of near copies costs a pass and not its
pairs. Larger clusters are never gathered. Each of their texts is compared with one hub of each of its keys, which
links nearly all of a group; then, where a key still holds several components, the texts outside of the key's largest
one are compared with all that have the key, in blocks of BLOCK against MOST. No pair that shares a key is left out.

Edge cases. Null and empty texts are copies of each other. Very long texts: the set of one text, eight bytes for each
of its different shingles, stands in memory at once. Null doc_id, repeated rows and the empty table: as in
simhash.py. Columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import Scratch, group_key
from .components import components
from .simhash import BITS, SEED, links, one_of_components, voted
from .words import lower_words, shingle_hashes

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 32, 5
#: Texts of a cluster that one task compares, and of those that are compared with all others of a key at a time.
MOST, BLOCK = 1024, 256
#: Odd factors: each permutes the 64-bit hashes.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    return _set_of(list(shingle_hashes(lower_words(text), SHINGLE, SEED)))


def _set_of(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def band_keys(own: np.ndarray) -> list[int]:
    """One signed key for each band; none of an empty set."""
    if not len(own):
        return []
    least = np.full(len(FACTORS), ~np.uint64(0))
    for i in range(0, len(own), 1024):
        np.minimum(least, (own[i : i + 1024, None] * FACTORS).min(axis=0), out=least)
    keys = [xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def connected(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """For each set the row of its component's first; components of all pairs at least so similar."""
    sizes, ends = np.array([len(s) for s in sets]), np.cumsum([len(s) for s in sets])
    vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
    own, mark = np.split(codes, ends[:-1]), np.zeros(len(vocabulary), bool)
    root, left = np.arange(len(sets)), np.arange(len(sets))
    while len(left):
        first, left = left[0], left[1:]
        queue = [first]
        while queue and len(left):
            x = queue.pop()
            near = left[(sizes[left] >= least * sizes[x] - 1) & (least * sizes[left] - 1 <= sizes[x])]
            if not len(near):
                continue
            mark[own[x]] = True
            starts = np.concatenate([[0], np.cumsum(sizes[near])[:-1]])
            shared = np.add.reduceat(mark[np.concatenate([own[i] for i in near])], starts, dtype=np.int64)
            mark[own[x]] = False
            hit = near[shared / (sizes[near] + sizes[x] - shared) >= least]
            root[hit] = first
            queue.extend(hit)
            left = left[root[left] != first]
    return root


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, __text (a hash of the text), __fp (a hash of the set), __sim (the SimHash fingerprint), __bands."""
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__text"), F.col(text_col).cast("string").alias("__own"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("__fp", T.LongType()), T.StructField("__sim", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sims, bands = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64), []
            for i, t in enumerate(b.column(2)):
                parts = list(shingle_hashes(lower_words(t.as_py()), SHINGLE, SEED))
                own = _set_of(parts)
                fps[i], sims[i] = xxh64_intdigest(own.tobytes(), SEED), voted(parts)
                bands.append(band_keys(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64)), pa.array(sims.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(each, schema)


def tree_keys(own: DataFrame, scratch: Scratch) -> DataFrame:
    """own(__fp, __sim, __bands) -> (__fp, __band): a key for all texts with words whose fingerprints simhash.py's trees connect."""
    worded = scratch.table(own.where(F.size("__bands") > 0).select("__fp", "__sim").distinct(), "fingerprints")
    found = scratch.table(links(worded.select(F.col("__sim").alias("__fp")).distinct(), BITS), "tree_links")
    label = components(found, scratch, "tree_stars").select(F.col("u").alias("__sim"), "label")
    label = worded.join(label, "__sim", "left").select("__fp", F.coalesce("label", "__sim").alias("label"))  # equal ones: no link
    return label.select("__fp", F.xxhash64(F.lit("tree"), "label").alias("__band"))


def _sets(texts: DataFrame) -> DataFrame:
    """(label, __fp, __own) -> (__fp, __set), the set's hashes as bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["__fp", "__set"])

    return texts.select("__fp", "__own").mapInArrow(each, "__fp long, __set binary")


def _near(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) >= least


def _in_blocks(sets: DataFrame, banded: DataFrame, scratch: Scratch, least: float = LEAST) -> DataFrame:
    """sets(__fp, __set) and banded(__fp, __band) -> (__fp, __root): components of near sets that share a key."""

    def near_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, hubs = (np.array([_near(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), least) for x, y in zip(b.column(2), b.column(3))], bool), b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), hubs], names=["u", "v"]).filter(pa.array(own))

    banded = scratch.table(banded, "large_bands")
    hubs = banded.groupBy("__band").agg(F.min("__fp").alias("__hub"))
    pairs = banded.join(hubs, "__band").where("__fp <> __hub").select("__fp", "__hub").distinct()
    with_sets = pairs.join(sets, "__fp").join(sets.select(F.col("__fp").alias("__hub"), F.col("__set").alias("__hub_set")), "__hub")
    links = scratch.table(with_sets.select("__fp", "__hub", "__set", "__hub_set").mapInArrow(near_hub, "u long, v long"), "hub_links")

    label = components(links, scratch, "hub_stars").select(F.col("u").alias("__fp"), "label")
    labelled = scratch.table(banded.join(label, "__fp", "left").select("__band", "__fp", F.coalesce("label", "__fp").alias("__label")), "labelled")
    counts = labelled.groupBy("__band", "__label").agg(F.count(F.lit(1)).alias("n"))
    open_keys = counts.groupBy("__band").agg(F.max_by("__label", F.struct("n", "__label")).alias("__main"), F.sum("n").alias("__all"), (F.sum("n") - F.max("n")).alias("__out"), F.count(F.lit(1)).alias("labels"))
    rows = labelled.join(open_keys.where("labels > 1"), "__band")
    spread = lambda count, size: F.ceil(F.col(count) / size).cast("long")
    rows = rows.withColumns({"__blocks": spread("__out", BLOCK), "__others": spread("__all", MOST), "__h": F.xxhash64("__fp")})
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = rows.where("__label <> __main").select("__band", F.pmod("__h", "__blocks").alias("__block"), every("__others").alias("__other"), "__fp", "__label", F.lit(True).alias("__asks"))
    asked = rows.select("__band", every("__blocks").alias("__block"), F.pmod("__h", "__others").alias("__other"), "__fp", "__label", F.lit(False).alias("__asks"))
    groups = asking.unionByName(asked).join(sets, "__fp")

    def compare(table: pa.Table) -> pa.Table:
        asks, fps, labels = table["__asks"].to_numpy(zero_copy_only=False), table["__fp"].to_numpy(), table["__label"].to_numpy()
        own = [np.frombuffer(x.as_py(), np.uint64) for x in table["__set"]]
        others = np.flatnonzero(~asks)
        sizes = np.array([len(own[i]) for i in others])
        if not len(others) or not asks.any():
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        vocabulary, codes = np.unique(np.concatenate([own[i] for i in others]), return_inverse=True)
        parts, u, v = np.split(codes, np.cumsum(sizes)[:-1]), [], []
        mark = np.zeros(len(vocabulary), bool)
        for i in np.flatnonzero(asks):
            n = len(own[i])
            near = np.flatnonzero((labels[others] != labels[i]) & (sizes >= least * n) & (least * sizes <= n))
            if not len(near):
                continue
            at = np.minimum(np.searchsorted(vocabulary, own[i]), len(vocabulary) - 1)
            hit = at[vocabulary[at] == own[i]]
            mark[hit] = True
            starts = np.concatenate([[0], np.cumsum(sizes[near])[:-1]])
            shared = np.add.reduceat(mark[np.concatenate([parts[k] for k in near])], starts, dtype=np.int64)
            mark[hit] = False
            close = near[shared / (sizes[near] + n - shared) >= least]
            u += [int(fps[i])] * len(close)
            v += fps[others[close]].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    more = groups.groupBy("__band", "__block", "__other").applyInArrow(compare, "u long, v long").distinct()
    joined = scratch.table(links.unionByName(more), "all_links")
    return components(joined, scratch, "all_stars").select(F.col("u").alias("__fp"), F.col("label").alias("__root"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_hash, fingerprint (the set's hash, 16 hex digits), component_id (the least doc_id)."""
    scratch = Scratch(docs.sparkSession)
    own = scratch.table(signatures(docs, id_col, text_col), "signatures")
    one = F.min(F.struct(group_key(F.col("__id")).alias("__key"), "__text")).alias("__one")
    classes = scratch.table(own.groupBy("__fp").agg(F.min("__id").alias("__least"), one), "classes")

    banded = own.select("__fp", F.explode("__bands").alias("__band")).unionByName(tree_keys(own, scratch)).distinct()
    banded = scratch.table(banded, "bands")
    hubs = banded.groupBy("__band").agg(F.min("__fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = banded.join(hubs, "__band").where("__fp <> v").select(F.col("__fp").alias("u"), "v").distinct()
    cluster = scratch.table(components(scratch.table(edges, "edges"), scratch).select(F.col("u").alias("__fp"), "label"), "clusters")
    large = scratch.table(cluster.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST).select("label"), "large")
    any_large = not large.isEmpty()
    small = cluster.join(large, "label", "left_anti") if any_large else cluster

    def compare(table: pa.Table) -> pa.Table:
        fps, at = np.unique(table["__fp"].to_numpy(), return_index=True)
        root = connected([shingle_set(table["__own"][int(i)].as_py()) for i in at])
        tied = np.bincount(root, minlength=len(root))[root] > 1
        return pa.table({"__fp": fps[tied], "__root": fps[root[tied]]})

    texts = docs.select(group_key(F.col(id_col)).alias("__key"), F.xxhash64(F.col(text_col)).alias("__text"), F.col(text_col).cast("string").alias("__own"))
    of = lambda some: texts.join(classes.join(some, "__fp").select("__fp", "label", "__one.*"), ["__key", "__text"]).select("label", "__fp", "__own")
    found = of(small).groupBy("label").applyInArrow(compare, "__fp long, __root long")
    if any_large:
        own_sets = scratch.table(_sets(of(cluster.join(large, "label", "left_semi"))).dropDuplicates(["__fp"]), "sets")
        found = found.unionByName(_in_blocks(own_sets, banded.join(own_sets.select("__fp"), "__fp", "left_semi"), scratch))
    tied = scratch.table(classes.select("__fp", "__least").join(scratch.table(found, "found"), "__fp"), "tied")
    tied = tied.join(tied.groupBy("__root").agg(F.min("__least").alias("__component")), "__root").select("__fp", "__component", F.lit(True).alias("__tied"))
    classes = classes.join(tied, "__fp", "left").select("__fp", F.when(F.col("__tied"), F.col("__component")).otherwise(F.col("__least")).alias("component_id"))
    out = own.select("__id", "__text", "__fp").join(classes, "__fp")
    return out.select(F.col("__id").alias("doc_id"), F.col("__text").alias("text_hash"), F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near copies: of each component, the row with the least doc_id stays (of equal rows, one)."""
    return one_of_components(docs, near_copies(docs, id_col, text_col), id_col, text_col)
