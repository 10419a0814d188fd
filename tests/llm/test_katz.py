"""Katz scores against a plain reading with dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marlstone.llm import katz

DOCS = "doc_id long, text string, __held string, words string"


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() + [" end"]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain_discount(counts):
    n = Counter(counts)
    if all(n[r] for r in range(1, 7)):
        common = 6 * n[6] / n[1]
        d = {r: ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) for r in range(1, 6)} if common != 1 else {1: 0}
        if all(0 < x < 1 for x in d.values()):
            return lambda r: d.get(r, 1)
    off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return lambda r: 1 - off / r if r <= 5 else 1


class Plain:
    """Counts by n-gram tuple; order n's contexts are the n - 1 tokens before, starts in front."""

    def __init__(self, docs, order=3):
        self.order = order
        train = [[" start"] * (order - 1) + tokens(t) for i, t in docs if not held_out(i)]
        self.count = [Counter() for _ in range(order + 1)]
        self.context = [Counter() for _ in range(order + 1)]
        for words in train:
            for n in range(1, order + 1):
                for at in range(order - 1, len(words)):
                    gram = tuple(words[at - n + 1 : at + 1])
                    self.count[n][gram] += 1
                    self.context[n][gram[:-1]] += 1
        self.one = Counter({w: c for (w,), c in self.count[1].items()})
        self.n, self.v = sum(self.one.values()), len(self.one)
        d = plain_discount(self.one.values())
        kept = sum(d(r) * r for r in self.one.values())
        over = self.n if kept < self.n else self.n + 1
        self.p1 = defaultdict(lambda: 1 - kept / over if self.n else 1, {w: d(r) * r / over for w, r in self.one.items()})
        self.d = [None, None] + [plain_discount(self.count[n].values()) for n in range(2, order + 1)]
        self.after = [defaultdict(dict) for _ in range(order + 1)]
        for n in range(2, order + 1):
            for gram, r in self.count[n].items():
                self.after[n][gram[:-1]][gram[-1]] = r

    def p(self, h, w):
        """h: the context, longest first; of any length."""
        n = len(h) + 1
        if n == 1:
            return self.p1[w]
        if h not in self.context[n]:
            return self.p(h[1:], w)
        seen, d = self.after[n][h], self.d[n]
        over = self.context[n][h] + (min(seen.values()) > 5)
        if w in seen:
            return d(seen[w]) * seen[w] / over
        kept = sum(d(r) * r for r in seen.values()) / over
        return (1 - kept) / (1 - sum(self.p(h[1:], x) for x in seen)) * self.p(h[1:], w)

    def row(self, doc_id, text):
        words = tokens(text)
        base = sum(math.log10((self.one[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in words)
        whole = [" start"] * (self.order - 1) + words
        score = sum(math.log10(self.p(tuple(whole[i : i + self.order - 1]), w)) for i, w in enumerate(words))
        return held_out(doc_id), len(words), sum(self.one[w] > 0 for w in words), self.n, base, score


def corpus(n, seed, vocabulary=120):
    draw = random.Random(seed)
    weights = [1 / (i + 1) for i in range(vocabulary)]
    words = [f"w{i}" if i % 7 else f"É{i}" for i in range(vocabulary)]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.randint(0, 40)))) for i in range(n)]
    return docs + [(5, docs[5][1]), (None, "W1 w1\tW2"), (None, None), (n, ""), (n + 1, "never seen"), (n + 2, "The " * 300)]


@pytest.mark.parametrize("how,n", [({}, 300), ({}, 12), ({"block": 150, "partition_tokens": 1000, "fan": 16}, 90), ({"block": 60, "partition_tokens": 40, "fan": 3}, 30)])
def test_matches_plain_reading(spark, how, n):
    docs = corpus(n, n)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS).repartition(3)
    found = sorted((r[0] is None, r[0] or 0, *r[1:4], r[4], r[5], r[6]) for r in katz.scores(df, **how).collect())
    model = Plain(docs)
    want = sorted((i is None, i or 0, *model.row(i, t)) for i, t in docs)
    assert [f[:6] for f in found] == [w[:6] for w in want]
    np.testing.assert_allclose([f[6:] for f in found], [w[6:] for w in want], rtol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_other_orders(spark, order):
    docs = corpus(60, 7, 30)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS).repartition(2)
    rows = katz.scores(df, order=order, block=64, partition_tokens=200, fan=3).collect()
    assert {r.discounting.count(",") for r in rows} == {order - 1}
    model = Plain(docs, order)
    np.testing.assert_allclose(sorted(r.score for r in rows), sorted(model.row(i, t)[5] for i, t in docs), rtol=1e-9)


@pytest.mark.parametrize("n", [300, 12])
@pytest.mark.parametrize("order", [2, 3, 4])
def test_probabilities_add_up(n, order):
    """At each order, after each context that the model knows and after an unknown one."""
    model = Plain(corpus(n, n), order)
    for k in range(1, order + 1):
        for h in [*list(model.context[k])[:300], ("nowhere",) * (k - 1)]:
            assert math.isclose(sum(model.p(h, w) for w in [*model.one, " unknown"]), 1, rel_tol=1e-9)


def test_rows_are_in_proportion_to_blocks(spark, monkeypatch):
    """Four times the blocks and partitions: about four times the rows that requests take, at each level of merging."""
    rows = {}
    for n in (16, 64):
        sent = []
        real = katz._exchange

        def counted(asks, *rest):
            sent.append(asks.count())
            return real(asks, *rest)

        monkeypatch.setattr(katz, "_exchange", counted)
        draw = random.Random(n)
        docs = [(i, " ".join(f"w{draw.randrange(60)}" for _ in range(99)), "", "") for i in range(n)]
        katz.scores(spark.createDataFrame(docs, DOCS).coalesce(1), block=100, partition_tokens=100, fan=4).count()
        monkeypatch.setattr(katz, "_exchange", real)
        rows[n] = max(sent)
        assert max(sent) <= 5 * n * 1.3
    assert rows[64] < 5 * rows[16]


def test_empty_and_all_held_out(spark):
    assert katz.scores(spark.createDataFrame([], DOCS)).count() == 0
    own = [i for i in range(50) if held_out(i)]
    rows = katz.scores(spark.createDataFrame([(i, "a b", None, None) for i in own], DOCS)).collect()
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(True, 3, 0, 0, 0.0, 0.0)}


def test_very_long_text_spans_blocks(spark):
    draw = random.Random(2)
    docs = [(0, " ".join(f"w{draw.randrange(50)}" for _ in range(20_000))), (6, "w1 w2 w3")]
    rows = {r.doc_id: r for r in katz.scores(spark.createDataFrame([(i, t, "", "") for i, t in docs], DOCS), block=700, partition_tokens=5000, fan=4).collect()}
    model = Plain(docs)
    for i, t in docs:
        want = model.row(i, t)
        assert rows[i].n_tokens == want[1] and math.isclose(rows[i].score, want[5], rel_tol=1e-9)


def test_model_beats_words_alone(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in katz.scores(df).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
