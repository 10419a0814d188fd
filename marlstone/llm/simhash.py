"""SimHash near-duplicates, found with vantage-point trees over the Hamming metric.

Fingerprint. Words (A-Z lower-cased, see words.py) give n-word shingles, repeats included; each shingle's
XXH64 (seed 42) votes on 64 bits, and a bit is 1 if over half of the votes are. No words: fingerprint 0.

Search. All pairs of distinct fingerprints with at most `bits` differing bits are wanted. A ball of radius 4
among 64 bits is too wide for triangle bounds: every node's boundary would hold most of the points. So the
metric is split: of `parts` = bits // 2 + 1 (two at least) bit ranges, two such fingerprints differ by at most one bit in
one of them at least. Over each range stands a vantage-point tree with search radius bits // parts, 1 for 4 bits. Its upper levels
(vantage points and median distances, from a bounded sample of fingerprints) deal the fingerprints to
shards: every fingerprint is a member of one shard; at a node, an inside point within the radius of the
boundary also visits the outer shard, and a visitor goes on to each branch that the triangle inequality
leaves open. Within a shard the tree goes on, and its leaves compare full fingerprints. Every pair within
reach meets in some leaf, whatever the vantage points are; these only decide how even the shards are.

Hot shards. No tree can part fingerprints that are equal in its range, and the upper tree's size is bounded. So
shards with more than MOST members are dealt again, by trees over three ranges of the bits outside of theirs (two
fingerprints within reach differ by one bit at most in one of these, too), and those still as large a third time;
by then 45 bits are used up, and 19 free bits bound what can be left. Within a shard, a leaf whose members are
equal in the tree's range goes on with the other bits in the same way. No step is a cap: every pair still meets.

Links. A shard sends no pairs on but a spanning forest of what its pairs connect, so a group of near copies
costs as many rows as it has fingerprints. The forests' union has the components of all links.

Edge cases. Null and empty texts: fingerprint 0, linked like any other. Very long texts: votes are added up over
blocks of 65,536 shingles; the text's words stand in memory once. Exact copies share a fingerprint and
enter the search once. Null doc_id: the row has a component, whose id is the least doc_id that is not null
(null if there is none). Repeated rows: each is returned. Empty table: no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, group_key, own_columns
from .components import components
from .words import lower_words, shingle_hashes

SEED, SHINGLE, BITS = 42, 4, 4
#: Fingerprints that an upper tree is fitted on, members that a shard shall have, an upper tree's depth at most,
#: members beyond which a shard is dealt again, and how often at most.
SAMPLE, SHARD, DEPTH, MOST, LEVELS = 4096, 4096, 14, 1 << 16, 3
LEAF = 192


def voted(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint of a text's shingle hashes."""
    votes, n = np.zeros(64, np.int64), 0
    for h in parts:
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return voted(shingle_hashes(lower_words(text), shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """__id, __text (a hash of the text), __fp (long, the fingerprint's bits)."""
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__text"), F.col(text_col).cast("string").alias("__fp"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("__fp", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.view(np.int64))], names=["__id", "__text", "__fp"])

    return rows.mapInArrow(each, schema)


def _ranges(bits: int, width: int = 64) -> list[tuple[int, int]]:
    """Of the `width` low bits: (shift, mask) of the ranges."""
    parts = max(2, bits // 2 + 1)  # 32 bits wide at most
    cuts = [width * i // parts for i in range(parts + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def _aside(fps: np.ndarray, at: tuple[int, int], width: int) -> tuple[np.ndarray, int]:
    """The same fingerprints with a range of the low bits moved above the others, and how many low bits are left."""
    own, one = at[1].bit_length(), np.uint64(1)
    low, high = (one << np.uint64(at[0])) - one, np.uint64(at[0] + own)
    free = (one << np.uint64(width)) - one if width < 64 else ~np.uint64(0)
    x = fps & free
    moved = (x & low) | ((x >> high if high < 64 else x & np.uint64(0)) << np.uint64(at[0])) | (_part(fps, at).astype(np.uint64) << np.uint64(width - own))
    return (fps & ~free) | moved, width - own


def _set_aside(fps: np.ndarray, path: tuple[int, ...], bits: int) -> tuple[np.ndarray, int]:
    """Fingerprints with the ranges of a path of trees moved out of the low bits, and how many low bits are left."""
    width = 64
    for p in path:
        fps, width = _aside(fps, _ranges(bits, width)[p], width)
    return fps, width


def _part(fps: np.ndarray, at: tuple[int, int]) -> np.ndarray:
    return ((fps >> np.uint64(at[0])) & np.uint64(at[1])).astype(np.uint32)


def _vantage(values: np.ndarray, draw: np.random.Generator) -> tuple[int, int] | None:
    """A vantage point and radius that part the values most evenly, of a few drawn; None if all are equal."""
    best = None
    for v in values[draw.integers(0, len(values), 6)]:
        d = np.bitwise_count(values ^ v)
        counts = np.bincount(d)
        inside = np.cumsum(counts)
        mu = int(np.argmin(np.abs(inside * 2 - len(values))))
        if 0 < inside[mu] < len(values) and (best is None or abs(int(inside[mu]) * 2 - len(values)) < best[0]):
            best = (abs(int(inside[mu]) * 2 - len(values)), int(v), mu)
    if best is None and (values != values[0]).any():
        return int(values[0]), 0
    return best and best[1:]


def _upper(sample: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Heap of vantage points and radii; nodes that the sample doesn't reach split at the width's half."""
    v, mu, draw = np.zeros(1 << depth, np.uint32), np.full(1 << depth, width // 2, np.int64), np.random.default_rng(depth)
    v[:] = draw.integers(0, 1 << width, len(v), dtype=np.uint32)
    at = {1: sample}
    for node in range(1, 1 << depth):
        own = at.pop(node, sample[:0])
        if len(own) >= 16 and (found := _vantage(own, draw)):
            v[node], mu[node] = found
        inside = np.bitwise_count(own ^ v[node]) <= mu[node]
        at[2 * node], at[2 * node + 1] = own[inside], own[~inside]
    return v, mu


def _branches(d: np.ndarray, mu: np.ndarray | int, member: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Who goes inside and who outside, and whether as a member. A pair that the boundary parts meets once, outside."""
    inside = d <= mu
    return inside | (~member & (d - radius <= mu)), inside & member, ~inside | (d + radius > mu), ~inside & member


def _dealt(fps: np.ndarray, trees: list, ranges: list, radius: int, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for p, ((v, mu), at) in enumerate(zip(trees, ranges)):
        x, row, node, member = _part(fps, at), np.arange(len(fps)), np.ones(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(depth):
            d = np.bitwise_count(x[row] ^ v[node]).astype(np.int64)
            go_in, own_in, go_out, own_out = _branches(d, mu[node], member, radius)
            row, node, member = np.concatenate([row[go_in], row[go_out]]), np.concatenate([2 * node[go_in], 2 * node[go_out] + 1]), np.concatenate([own_in[go_in], own_out[go_out]])
        yield p, row, node, member


class _Forest:
    """Union of links between rows, kept as roots that are the least row of each tree."""

    def __init__(self, n: int):
        self.root, self.held, self.n_held = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.n_held += len(a)
        if self.n_held > 1 << 20:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.held:
            a, b = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.n_held, root = [], 0, self.root
            while len(a):
                ra, rb = root[a], root[b]
                apart = ra != rb
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                while (root != (up := root[root])).any():
                    root = up
            self.root = root
        return self.root


def _compare(fps: np.ndarray, members: np.ndarray, others: np.ndarray, bits: int, forest: _Forest, block: int = 1024) -> None:
    """Links members to others (and to each other). Blocks that are one tree already need no look."""
    everyone = np.concatenate([members, others])
    for i in range(0, len(members), block):
        a = members[i : i + block]
        for j in range(i, len(everyone), block):
            b = everyone[j : j + block]
            if len(members) > block:
                root = forest.settle()
                if (root[b] == root[a[0]]).all() and (root[a] == root[a[0]]).all():
                    continue
            x, y = np.nonzero(np.bitwise_count(fps[a][:, None] ^ fps[b][None, :]) <= bits)
            if (apart := a[x] != b[y]).any():
                forest.add(a[x[apart]], b[y[apart]])


def _search(fps: np.ndarray, member: np.ndarray, at: tuple[int, int], bits: int, radius: int, width: int = 64) -> np.ndarray:
    """Roots of the rows of a shard, linked where they are within `bits`. Of each, `width` low bits are in no range so far."""
    forest, x, draw = _Forest(len(fps)), _part(fps, at), np.random.default_rng(len(fps))
    rows = np.arange(len(fps))
    stack = [(rows[member], rows[~member])]
    while stack:
        own, guests = stack.pop()
        if not len(own):
            continue
        found = _vantage(x[own], draw) if len(own) > LEAF else None
        both = np.concatenate([own, guests])
        if found is None:
            if len(own) > LEAF and width - at[1].bit_length() >= 4 * (bits + 1):
                root = forest.settle()
                if (root[both] != root[both[0]]).any():
                    rest, left = _aside(fps[both], at, width)
                    for other in _ranges(bits, left):
                        forest.add(both, both[_search(rest, np.ones(len(rest), bool), other, bits, radius, left)])
            else:
                _compare(fps, own, guests, bits, forest)
            continue
        v, mu = np.uint32(found[0]), found[1]
        is_own = np.arange(len(both)) < len(own)
        go_in, own_in, go_out, own_out = _branches(np.bitwise_count(x[both] ^ v).astype(np.int64), mu, is_own, radius)
        for go, still in ((go_in, own_in), (go_out, own_out)):
            stack.append((both[go & still], both[go & ~still]))
    return forest.settle()


def _dealer(trees: dict[tuple[int, ...], list], names: list[str], bits: int, radius: int, depth: int):
    """Rows (fp, shards so far) -> (fp, shards and the next one, whether a member there)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint64)
            shards = [b.column(i + 1).to_numpy() for i in range(len(names))]
            ways = np.stack([s & 63 for s in shards], axis=1) if names else np.zeros((len(own), 0), np.int64)
            for path, tree in trees.items():
                here = np.flatnonzero((ways == np.array(path, np.int64)).all(axis=1))
                for i in range(0, len(here), 4096):
                    part = here[i : i + 4096]
                    fps, width = _set_aside(own[part], path, bits)
                    for p, row, node, member in _dealt(fps, tree, _ranges(bits, width), radius, depth):
                        at = part[row]
                        yield pa.RecordBatch.from_arrays([pa.array(own[at].view(np.int64)), *[pa.array(s[at]) for s in shards], pa.array((node << 6) | p), pa.array(member)], names=["fp", *names, f"s{len(names)}", "member"])

    return each


def _searcher(names: list[str], bits: int, radius: int):
    def search(table: pa.Table) -> pa.Table:
        own, member = table["fp"].to_numpy().view(np.uint64), table["member"].to_numpy()
        order = np.lexsort((own, ~member))  # the same rows give the same forest, however they arrive
        own, member = own[order], member[order]
        *path, last = (table[n][0].as_py() & 63 for n in names)
        fps, width = _set_aside(own, tuple(path), bits)
        root = _search(fps, member, _ranges(bits, width)[last], bits, radius, width)
        tied = root != np.arange(len(root))
        return pa.table({"u": own[tied].view(np.int64), "v": own[root[tied]].view(np.int64)})

    return search


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Distinct fps(__fp) -> (u, v): a set of links within `bits` that connects all that such links connect."""
    left, largest, scratch = fps.select(F.col("__fp").alias("fp")), fps.count(), Scratch(fps.sparkSession)
    parts, out, names = len(_ranges(bits)), None, []
    radius = bits // parts
    for level in range(LEVELS):
        depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(1, largest / SHARD))))))
        rows = [tuple(r) for r in left.orderBy(F.xxhash64("fp", *names)).limit(SAMPLE).collect()]
        sample = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        ways = np.array([[s & 63 for s in r[1:]] for r in rows], np.int64).reshape(len(rows), level)
        trees = {}
        for path in product(range(parts), repeat=level):
            own, width = _set_aside(sample[(ways == np.array(path, np.int64)).all(axis=1)], path, bits)
            trees[path] = [_upper(_part(own, at), depth, at[1].bit_length()) for at in _ranges(bits, width)]
        kinds = ", ".join(f"{n} long" for n in ["fp", *names, f"s{level}"])
        dealt = scratch.table(left.mapInArrow(_dealer(trees, list(names), bits, radius, depth), f"{kinds}, member boolean"), f"dealt{level}")
        names, again = [*names, f"s{level}"], None
        if level < LEVELS - 1 and largest > MOST:
            sizes = dealt.where("member").groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST)
            sizes = scratch.table(sizes, f"large{level}")
            if largest := sizes.agg(F.max("n")).first()[0]:
                again = scratch.table(dealt.join(sizes, names, "left_semi").select("fp", *names), f"again{level}")
                dealt = dealt.join(sizes, names, "left_anti")
        found = dealt.groupBy(*names).applyInArrow(_searcher(list(names), bits, radius), "u long, v long")
        out = found if out is None else out.unionByName(found)
        if again is None:
            break
        left = again
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Per row: doc_id, text_hash, fingerprint (16 hex digits), component_id."""
    scratch = Scratch(docs.sparkSession)
    own = scratch.table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = scratch.table(own.groupBy("__fp").agg(F.min("__id").alias("__least")), "classes")
    label = components(scratch.table(links(classes, bits), "links"), scratch).select(F.col("u").alias("__fp"), "label")
    tied = scratch.table(classes.join(label, "__fp"), "tied")
    tied = tied.join(tied.groupBy("label").agg(F.min("__least").alias("__component")), "label").select("__fp", "__component", F.lit(True).alias("__tied"))
    classes = classes.join(tied, "__fp", "left").select("__fp", F.when(F.col("__tied"), F.col("__component")).otherwise(F.col("__least")).alias("component_id"))
    out = own.join(classes, "__fp")
    return out.select(F.col("__id").alias("doc_id"), F.col("__text").alias("text_hash"), F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, similarity: bool = False) -> DataFrame:
    """docs without the near copies: of each component, the row with the least doc_id stays (of equal rows, one).

    similarity: near copies are those of near_copies.py: candidates from fingerprints that differ in few bits and from
    MinHash, which must have 5-word shingle sets with Jaccard 0.8 or more. A component whose ids are all null keeps one row for each of its different texts.
    """
    if similarity:
        from . import near_copies

        return near_copies.one_of_each(docs, id_col, text_col)
    return one_of_components(docs, near_duplicates(docs, id_col, text_col, shingle, bits), id_col, text_col)


def one_of_components(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """one_of_each for components that are found already (columns as of near_duplicates)."""
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(group_key(F.col("component_id")).alias("__key"), "fingerprint").agg(F.min("text_hash").alias("__text"))
    first = kept.groupBy("__key").agg(F.min("__text").alias("__first"))
    kept = kept.join(first, "__key").where("__key = '1' or __text = __first").select("__key", "__text").distinct()
    rows = docs.select(own_columns(docs).alias("__row"), group_key(F.col(id_col)).alias("__key"), F.xxhash64(F.col(text_col)).alias("__text"))
    return rows.join(kept, ["__key", "__text"]).dropDuplicates(["__key", "__text"]).select("__row.*")
