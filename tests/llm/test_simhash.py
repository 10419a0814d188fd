"""SimHash against a plain reading of its definition and all pairs."""

import random

import numpy as np
import pytest
import xxhash

from marlstone.llm import simhash

DOCS = "doc_id long, text string, component_id string"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def texts(n, seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    out = []
    for _ in range(n):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(60, 160))]
        out.append(" ".join(base))
        for _ in range(draw.randint(0, 3)):
            copy = list(base)
            copy[draw.randrange(len(copy))] = "other"
            out.append("\n".join(copy).upper())
    return out


def test_matches_plain_reading(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 32)
    rows = texts(150, 1) + ["", None, " \t", "One", "one", "a b c", "Ä b C d"] + ["x y z " * 5000]
    found = simhash.near_duplicates(spark.createDataFrame([(i, t, "c") for i, t in enumerate(rows)], DOCS).repartition(5)).collect()
    fps = [plain_fingerprint(t) for t in rows]
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{x:016x}" for i, x in enumerate(fps)}
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(plain_components(fps)))
    assert len(set(plain_components(fps))) < len(fps)


@pytest.mark.parametrize("depth", [0, 1, 5])
def test_tree_finds_every_pair(depth):
    draw = np.random.default_rng(depth)
    centre = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
    flips = [centre ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, (k, 400), dtype=np.uint64), axis=0) for k in (1, 3, 4, 5)]
    fps = np.unique(np.concatenate([centre, *flips]))
    ranges, radius = simhash._ranges(4), 1
    trees = [simhash._upper(simhash._part(fps[::7], at), depth, at[1].bit_length()) for at in ranges]
    forest = simhash._Forest(len(fps))
    for p, row, node, member in simhash._dealt(fps, trees, ranges, radius, depth):
        assert np.bincount(row[member], minlength=len(fps)).tolist() == [1] * len(fps)
        for shard in np.unique(node):
            own = row[node == shard]
            root = simhash._search(fps[own], member[node == shard], ranges[p], 4, radius)
            forest.add(own, own[root])
    assert forest.settle().tolist() == plain_components([int(x) for x in fps])


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 6])
def test_other_reaches(spark, bits):
    draw = np.random.default_rng(bits)
    base = draw.integers(0, 1 << 62, 60, dtype=np.int64)
    fps = np.unique(np.concatenate([base, *[base ^ (1 << int(b)) for b in (3, 40)], base ^ (1 << 5) ^ (1 << 50)]))
    found = simhash.links(spark.createDataFrame([(int(x),) for x in fps], "__fp long"), bits).collect()
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        assert (r.u ^ r.v).bit_count() <= 64
        root[find(r.u)] = find(r.v)
    for i, a in enumerate(map(int, fps)):
        for b in map(int, fps[:i]):
            if (a ^ b).bit_count() <= bits:
                assert find(a) == find(b)
    assert found if bits else not found


def hot(n, seed):
    """Fingerprints that are equal in the first range, each with a near one."""
    draw = np.random.default_rng(seed)
    low = (1 << 21) - 1
    base = (draw.integers(0, 1 << 63, n, dtype=np.uint64) & ~np.uint64(low)) | np.uint64(77)
    flips = [base ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(21, 64, (k, n), dtype=np.uint64), axis=0) for k in (2, 4)]
    return np.unique(np.concatenate([base, *flips]))


def test_bits_move_aside_and_keep_distances():
    fps, width = hot(50, 1), 64
    moved = fps
    for p in (1, 2, 0):
        moved, width = simhash._aside(moved, simhash._ranges(4, width)[p], width)
        assert (np.bitwise_count(moved[:, None] ^ moved[None]) == np.bitwise_count(fps[:, None] ^ fps[None])).all()
    assert width == 64 - 21 - 15 - 9


def test_hot_shards_are_dealt_again(spark, monkeypatch):
    for name, value in (("MOST", 40), ("SHARD", 16), ("DEPTH", 3)):
        monkeypatch.setattr(simhash, name, value)
    fps = np.unique(np.concatenate([hot(150, 2), np.random.default_rng(4).integers(0, 1 << 63, 100, dtype=np.uint64)]))
    found = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "__fp long"))
    assert "s2" in str(found._jdf.queryExecution().logical().toString())
    root = np.arange(len(fps))
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    forest = simhash._Forest(len(fps))
    for r in found.collect():
        assert ((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 64
        forest.add(np.array([at[r.u]]), np.array([at[r.v]]))
    root = forest.settle().tolist()
    assert root == plain_components([int(x) for x in fps])


def test_equal_ranges_cost_no_square():
    import time

    fps = hot(20_000, 3)
    began = time.perf_counter()
    root = simhash._search(fps, np.ones(len(fps), bool), simhash._ranges(4)[0], 4, 1)
    assert len(fps) > 59_000 and len(set(root.tolist())) <= 20_000
    assert time.perf_counter() - began < 20


def test_dense_ball_is_one_component():
    draw = np.random.default_rng(3)
    fps = np.unique(np.uint64(12345) ^ (np.uint64(1) << draw.integers(0, 64, 6000, dtype=np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 6000, dtype=np.uint64)))
    assert set(simhash._search(fps, np.ones(len(fps), bool), (0, (1 << 21) - 1), 4, 1)) == {0}


def test_nulls_repeats_and_empty(spark):
    same = "a b c d e f g h"
    rows = [(None, same, None), (7, same, None), (3, same, "x"), (3, same, "x"), (None, "other words stand here alone", None), (9, None, None), (8, "", None)]
    df = spark.createDataFrame(rows, DOCS)
    found = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(found, key=str) == sorted([(None, 3), (7, 3), (3, 3), (3, 3), (None, None), (9, 8), (8, 8)], key=str)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, same, "x"), (None, "other words stand here alone", None), (8, "", None)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.one_of_each(df.limit(0)).count() == 0
