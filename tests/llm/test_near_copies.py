"""Near copies of the pipeline's dedup stage against all pairs."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from marlstone.llm import near_copies, simhash

DOCS = "doc_id long, text string, component_id string"


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_kept(rows):
    """The least id of each component of pairs with Jaccard 0.8 or more."""
    sets, root = {i: plain_set(t) for i, t, *_ in rows}, {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return sorted({find(i) for i in root})


def texts():
    draw, out = random.Random(5), []
    for _ in range(60):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.choice((8, 60, 200, 400)))]
        out.append(" ".join(base))
        for share in (0.01, 0.02, 0.03, 0.06):
            out.append("\n".join(w if draw.random() > share else f"x{draw.randrange(9)}" for w in base).upper())
    return out


@pytest.mark.parametrize("most,block", [(1024, 256), (3, 2)])
def test_stage_drops_what_all_pairs_drop(spark, monkeypatch, most, block):
    """Large clusters are compared in blocks: with (3, 2) all clusters of more than three texts are."""
    monkeypatch.setattr(near_copies, "MOST", most)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rows = [(i, t, "c") for i, t in enumerate([*texts(), "", None, " \t", "One", "one", "a b c d", "A B C D"])]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    kept = corpus_pipeline.drop_copies(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) != plain_kept(rows)


def test_short_texts_that_share_bits_stay(spark):
    """Near in SimHash is not enough: two of eight words differ, Jaccard 0."""
    rows = [(1, "a b c d e f g h", None), (2, "a b c d x f g h", None), (3, "a b c d e f g h", None)]
    assert sorted(r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(rows, DOCS)).collect()) == [1, 2]


def test_dense_group_is_one_component():
    import numpy as np

    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, draw.integers(0, 300, 12)), draw.integers(0, 1 << 63, 12, dtype=np.uint64)])) for _ in range(400)]
    assert set(near_copies.connected(sets)) == {0}


def test_nulls_and_empty(spark):
    same = "a b c d e f g h"
    rows = [(None, same, None), (7, same, None), (3, same, "x"), (3, same, "x"), (None, "other words stand here alone", None), (9, None, None), (8, "", None)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, near_copies.one_of_each(df).collect()), key=str) == sorted([(3, same, "x"), (None, "other words stand here alone", None), (8, "", None)], key=str)
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_trees_give_keys_to_texts_with_near_fingerprints(spark):
    """The dedup stage searches by SimHash and vantage-point trees; MinHash keys come on top."""
    from marlstone.llm import near_copies, simhash
    from marlstone.llm.common import Scratch

    long = " ".join(f"w{i}" for i in range(3000))
    changed = lambda k: " ".join(f"w{i}" if i >= k else f"x{i}" for i in range(3000))
    near = next(t for t in map(changed, range(10, 400, 10)) if simhash.fingerprint(t, 5) != simhash.fingerprint(long, 5))
    texts = {1: long, 2: near, 3: " ".join(f"v{i}" for i in range(3000)), 4: "", 5: None}
    sims = {k: simhash.fingerprint(t, near_copies.SHINGLE) for k, t in texts.items()}
    assert 0 < (sims[1] ^ sims[2]).bit_count() <= simhash.BITS < (sims[1] ^ sims[3]).bit_count()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    own = Scratch(spark).table(near_copies.signatures(docs, "doc_id", "text"), "own")
    assert {r["__id"]: r["__sim"] & (2**64 - 1) for r in own.collect()} == sims
    keys = {r["__id"]: r["__band"] for r in own.join(near_copies.tree_keys(own, Scratch(spark)), "__fp").collect()}
    assert set(keys) == {1, 2, 3} and keys[1] == keys[2] != keys[3]
