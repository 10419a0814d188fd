"""Mixing and sharding against plain readings."""

import math
from collections import Counter, defaultdict

from marlstone.llm import mixing, sharding

DOCS = "doc_id long, text string, source string, size string, shard int"


def rows(n):
    out = [(i, "w " * (i * 7 % 40), ["b", "a", None, "cé", ""][(i * i) % 5 if i % 3 else 0], "s", 1) for i in range(n)]
    return out + [(3, "w w", "a", "s", 1)] * 3 + [(None, "q q", None, None, None)] * 2 + [(None, None, "a", None, None), (n + 1, " \t ", "zero", "s", 1)]


def plain_targets(sizes, share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, got = share * sum(sizes.values()), set(names), {}
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] >= cap * sizes[s]]
        if not over:
            return got | part
        for s in over:
            got[s] = cap * sizes[s]
            left -= got[s]
            open_.discard(s)
    return got


def test_mix(spark):
    data = rows(400)
    found = mixing.mix(spark.createDataFrame(data, DOCS).repartition(3)).collect()
    sizes = Counter()
    for _, text, source, *_ in data:
        sizes[source] += len((text or "").split())
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(d[0]), len((d[1] or "").split())) for d in data)
    want, by_size = plain_targets(sizes), {v: k for k, v in sizes.items()}
    assert len(by_size) == len(sizes)
    taken = Counter()
    for r in found:
        source = by_size[r.source_size]
        assert math.isclose(r.target, want[source])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 2 * 39
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(spark.createDataFrame(data, DOCS)).collect()))


def test_resample_emits_what_mix_counts(spark):
    data = rows(200)
    df = spark.createDataFrame(data, DOCS)
    copies = Counter(tuple(r) for r in mixing.resample(df).collect())
    assert set(copies) <= {tuple(d) for d in data}
    per_id = defaultdict(int)
    for row, n in copies.items():
        per_id[row[0]] += n * len((row[1] or "").split())
    found = defaultdict(int)
    for r in mixing.mix(df).collect():
        found[r.doc_id] += r.taken
    assert {k: v for k, v in per_id.items() if v} == {k: v for k, v in found.items() if v}
    assert mixing.resample(df).columns == df.columns


def test_interleave(spark):
    data = rows(997)
    found = sharding.interleave(spark.createDataFrame(data, DOCS).repartition(3), 24).collect()
    assert len(found) == len(data)
    shards = defaultdict(list)
    for r in found:
        shards[r.shard].append(r)
    counts = [len(x) for x in shards.values()]
    assert len(shards) == 24 and max(counts) - min(counts) <= 1
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total = Counter(r.source for r in found)
    for own in shards.values():
        here = Counter(r.source for r in own)
        for source, n in total.items():
            assert abs(here[source] - n / 24) < 2
    few = sharding.interleave(spark.createDataFrame(data[:5], DOCS), 24).collect()
    assert len({r.shard for r in few}) == 5 and {r.slot for r in few} == {0}


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix(df).count() == mixing.resample(df).count() == sharding.interleave(df).count() == 0
