"""Operators on small tables with hand-worked or brute-force results."""

import json
import math
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.functions import exprs as X
from marlstone.operators import aggregate as A
from marlstone.operators import curation as C
from marlstone.operators import documents as D
from marlstone.operators import endpoints as E
from marlstone.operators import match as M
from marlstone.operators import shape
from marlstone.operators import splits as S
from marlstone.operators import window as W
from marlstone.sources import readers, writers
from marlstone.streaming import append


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("text,want", [("12.5", 12.5), ("1e-3", 0.001), ("2; 4", 3.0), ("1, 2, 6", 3.0), ("10-20", 15.0), ("10–20", 15.0), ("abc", None), ("", None), (None, None), ("-5", -5.0), ("about 7 mg", 7.0), ("5 ± 1", 3.0), ("1-3; 9", 2.0), ("4 to 6", 5.0)])
def test_coerce_number(spark, text, want):
    assert one(spark, X.coerce_number(F.col("v")), v=text) == want


@pytest.mark.parametrize("text,kind,centre", [("5 ± 1", "uncertainty", 5.0), ("5 +/- 1", "uncertainty", 5.0), ("3-7", "range", 5.0), ("3; 7", "list", None), ("42", "single", 42.0), ("1 && 2-3", "list", None), ("5 mg", "single", 5.0), ("5 mg, x", "single", 5.0), ("2 to 4", "range", 3.0), ("5 and 6", "none", None), ("none", "none", None), (None, "none", None)])
def test_classify_value(spark, text, kind, centre):
    assert tuple(one(spark, X.classify_value(F.col("v")), v=text)) == (kind, centre)


@pytest.mark.parametrize("text,want", [("3; 1; 3; 0", [1.0, 3.0]), ("5-2", [2.0, 5.0]), ("0", [0.0]), ("x", []), (None, [])])
def test_endpoints(spark, text, want):
    assert one(spark, X.endpoints(F.col("v")), v=text) == want


@pytest.mark.parametrize("value,want", [("50 %", 0.5), ("1", 1.0), ("1.5", 0.015), ("0.333333333", 0.333333), ("0", 0.0), (None, None)])
def test_percent(spark, value, want):
    assert one(spark, X.percent_to_fraction(F.col("v")), v=value) == pytest.approx(want)


def test_missing_and_flags(spark):
    rows = [(t,) for t in (None, "", " NaN ", "N/A", "x", "0", "Yes", "T", "no")]
    got = spark.createDataFrame(rows, "v string").select(X.is_missing(F.col("v")), X.is_true(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(True, False)] * 4 + [(False, False)] * 2 + [(False, True)] * 2 + [(False, False)]


@pytest.mark.parametrize("unit,want", [("mM", "mmol/l"), ("M", "mol/l"), ("µg L-1", "ug/l"), ("mg L^-1", "mg/l"), ("ppb", "ug/l"), ("mg·L⁻¹", "mg/l"), ("Hours", "h")])
def test_units(spark, unit, want):
    assert one(spark, X.normalize_unit(F.col("v")), v=unit) == want


@pytest.mark.parametrize("cas,ok", [("335-67-1", True), ("1763-23-1", True), ("335-67-2", False), ("x", False), (None, False)])
def test_cas(spark, cas, ok):
    assert (one(spark, X.cas_number(F.col("v")), v=cas) is not None) == ok


def test_tolerance_rules(spark):
    t = M.Tolerance(1.0, True)
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (None, 1.0), (10.0, 1.0), (100.0, 1.0)], "a double, b double")
    got = [r[0] for r in rows.select(t.distance(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [0.0, None, None] and got[3] == pytest.approx(1) and got[4] == pytest.approx(2)


def test_cascade_needs_one_candidate(spark):
    left = spark.createDataFrame([(1, "a", "v"), (None, "a", "v"), (None, "b", "v"), (None, "b", "w")], "k int, alias string, vendor string")
    facts = spark.createDataFrame([(1, 1, "a", "v"), (2, 2, "b", "w"), (3, 3, "b", "v")], "id int, k int, alias string, vendor string")
    out = M.cascade(left, [(c, M.unique_index(facts, c, "id")) for c in ("k", "alias", "vendor")], "id").select("k", "alias", "vendor", "id", "matched_by").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, "a", "v", 1, "k"), (None, "a", "v", 1, "alias"), (None, "b", "v", None, None), (None, "b", "w", 2, "vendor")], key=str)


def test_checked_join_fails_on_repeats(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="repeats"):
        M.checked_join(a, a.distinct(), ["k"]).collect()


def test_equal_source_weights(spark):
    df = A.equal_source_weights(spark.createDataFrame([(10, 0.0), (10, 10.0), (20, 0.0)], "s int, y double"), "s")
    w = sorted((r["s"], r["weight"]) for r in df.collect())
    assert [x for _, x in w] == pytest.approx([0.75, 0.75, 1.5])
    assert df.agg(A.regression(F.col("y"), F.lit(0.0), F.col("weight"))["mae"]).first()[0] == pytest.approx(2.5)


def test_entropy_of_studies(spark):
    rows = [(0.2284,), (0.7716,)]
    h = spark.createDataFrame(rows, "p double").agg(A.entropy(F.col("p"))).first()[0]
    assert h == pytest.approx(-sum(p * math.log(p) for (p,) in rows))


def test_coalesce_rows(spark):
    rows = [("a", 2, "late", "y", True), ("a", 1, "", "x", None), ("a", 3, "last", "x", None), (None, 4, "z", "z", None), ("", 5, "q", "q", False)]
    out = A.coalesce_rows(spark.createDataFrame(rows, "k string, i int, v string, s string, f boolean"), "k", ["i"], ["v"], {"s": "; "}, ["f"]).collect()
    assert sorted(map(tuple, out), key=str) == sorted([("a", "late", "x; y", True, 3), (None, "z", "z", None, 1), ("", "q", "q", False, 1)], key=str)


def test_average_rank_and_spearman(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 2.0), (4.0, 4.0), (None, 9.0)], "x double, y double").withColumn("g", F.lit(1))
    assert sorted(r[0] for r in df.where("x is not null").select(W.average_rank("x")).collect()) == [1.0, 2.5, 2.5, 4.0]
    assert A.spearman(df, ["g"], "x", "y").first()["spearman"] == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [1, 3, 2, 4])[0, 1])


def test_diverse_top_keeps_plain_order_if_all_fit(spark):
    rows = [(1, "A", 4.0, 1), (1, "A", 3.0, 2), (1, "A", 2.0, 3), (1, "B", 1.0, 4)]
    df = spark.createDataFrame(rows, "g int, f string, s double, i int")
    order = lambda k: [r["i"] for r in sorted(W.diverse_top(df, ["g"], "f", "s", "i", k).collect(), key=lambda r: r["place"])]
    assert order(4) == [1, 2, 3, 4] and order(3) == [1, 2, 4]


def test_batches_and_borrow(spark):
    got = spark.createDataFrame([([5, 6, 20, 1, 1],)], "a array<bigint>").select(W.batches(F.col("a"), 10)).first()[0]
    assert got == [0, 1, 2, 3, 3]
    rows = [(1, "a", "x"), (1, "a", None), (1, "b", None), (2, "c", "x"), (2, "c", "y"), (2, "c", None), (2, "d", None)]
    out = W.borrow_unanimous(spark.createDataFrame(rows, "s int, o string, u string"), "u", [["s", "o"], ["s"]]).collect()
    assert sorted((r["s"], r["o"], r["u"] or "", r["u_from"]) for r in out if r["u_from"] is not None or not r["u"]) == [(1, "a", "x", 0), (1, "b", "x", 1), (2, "c", "", None), (2, "d", "", None)]


def test_merge_short_runs(spark):
    rows = [(1, 1, "s", "a"), (1, 2, "s", "b"), (1, 3, "t", "c"), (1, 4, "t", "w " * 60), (1, 5, "t", "d")]
    out = W.merge_short_runs(spark.createDataFrame(rows, "k int, i int, s string, t string"), ["k"], "i", "s", "t").orderBy("run").collect()
    assert [(r["t"].strip()[:5], r["pieces"]) for r in out] == [("a\n\nb", 2), ("c", 1), ("w w w", 1), ("d", 1)]


def test_freundlich_root(spark):
    draw = np.random.default_rng(0)
    rows = [tuple(map(float, r)) for r in np.stack([draw.uniform(0.01, 50, 200), draw.uniform(1, 500, 200), draw.uniform(0.01, 50, 200), draw.uniform(0.2, 1.5, 200)], axis=1)]
    c = [F.col(x) for x in "cdke"]
    for r in spark.createDataFrame(rows, "c double, d double, k double, e double").withColumn("x", E.ce_freundlich(*c)).collect():
        assert 0 < r.x < r.c and abs(r.x + r.d / 1000 * r.k * r.x**r.e - r.c) < 1e-9


def test_reference_dose(spark):
    rows = [(1, 1.0, 100.0, None, "Langmuir", 100.0, 2.0, 0.99, None, None, None), (2, 0.8, 10.0, None, "x", None, None, None, 12.0, 0.7, 0.97), (3, 1.0, 23.0, 1.0, "Removal", None, None, None, None, None, None), (4, 1.0, 100.0, 1.0, "x", 100.0, 2.0, 0.75, None, None, None), (5, 1.0, 9.0, 1.0, "Freundlich", 100.0, 2.0, 0.99, 12.0, 0.7, 0.95)]
    df = spark.createDataFrame(rows, "i int, c0 double, d double, logkd double, source string, qm double, kl double, r2l double, kf double, ex double, r2f double")
    out = {r["i"]: r for r in E.reference_dose(df, "c0", "d", "logkd", "source", ("qm", "kl", "r2l"), ("kf", "ex", "r2f")).collect()}
    assert sorted(out) == [1, 2, 3, 5]
    ce = out[1]["ref_ce"]
    q = 100 * 2 * ce / (1 + 2 * ce)
    assert out[1]["ref_basis"] == "Langmuir" and out[1]["ref_exact"] and abs(ce + 0.025 * q - 1) < 1e-10 and out[1]["ref_logkd"] == pytest.approx(math.log10(q / ce))
    ce = out[2]["ref_ce"]
    assert out[2]["ref_basis"] == "Freundlich" and abs(ce + 0.025 * 12 * ce**0.7 - 0.8) < 1e-10
    assert (out[3]["ref_basis"], out[3]["ref_exact"], out[3]["ref_dose"], out[3]["ref_logkd"]) == ("observed_dose_within_tolerance", False, 23.0, 1.0)
    assert out[5]["ref_basis"] == "Freundlich"


@pytest.mark.parametrize("value,percent,want", [(1.0, False, None), (1.5, False, 0.015), (99.0, True, 0.99), (100.0, True, None), (-1.0, False, 0.0), (None, False, None)])
def test_removal_fraction(spark, value, percent, want):
    got = spark.createDataFrame([(value,)], "v double").select(E.removal_fraction(F.col("v"), F.lit(percent))).first()[0]
    assert got == (pytest.approx(want) if want is not None else None)


def test_splits(spark):
    df = spark.createDataFrame([(g, i) for g in range(20) for i in range(g % 5 + 1)], "g int, i int")
    out = S.group_holdout(df, "g", 0.25)
    assert S.membership_violations(out, "g").count() == 0 and out.where("split = 'test'").select("g").distinct().count() == 5
    folds = S.balanced_folds(df, "g", 4).groupBy("fold").count().collect()
    assert max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 1
    sized = S.size_matched_holdout(df, "g", 0.3)
    assert sized.where("split = 'test'").count() == round(0.3 * df.count()) and S.membership_violations(sized, "g").count() == 0
    pairs = S.pair_holdout(spark.createDataFrame([(a, b) for a in range(4) for b in range(3)], "a int, b int"), "a", "b", 0.4).collect()
    train = [r for r in pairs if r["split"] == "training"]
    assert {r["a"] for r in train} == set(range(4)) and {r["b"] for r in train} == set(range(3)) and len(train) < 12
    assert S.group_holdout(df.limit(0), "g", 0.5).count() == 0


def test_nearest_against_all_pairs(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    got = {(r["id"], r["place"]): r["neighbour"] for r in S.nearest(df, df, "id", "v", k=3, block=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert got == {(i, k + 1): int(np.argsort(-s[i])[k]) for i in range(60) for k in range(3)}


def test_range_support(spark):
    t = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, c string")
    q = spark.createDataFrame([(3.0, "a"), (1.5, "z"), (None, None)], "x double, c string")
    assert [tuple(map(tuple, r[2:])) for r in S.range_support(t, q, ["x"], ["c"]).collect()] == [(("x",), (), ()), ((), ("c",), ()), ((), (), ("x", "c"))]


def test_documents(spark):
    got = spark.createDataFrame([("See Figs. 2–4 and Fig. S1; figure 3",), ("Fig. 5-70",), ("none",)], "t string").select(D.figure_ids(F.col("t"))).collect()
    assert [r[0] for r in got] == [["2", "3", "4", "S1"], ["5"], []]
    assert one(spark, D.markdown_cells(F.col("v")), v=r"| a | b \| c | |") == ["a", "b | c", ""]
    assert one(spark, D.classify_heading(F.col("v")), v="## 2.1. Materials and Methods") == "methods"
    t = spark.createDataFrame([(1, 0, "head"), (1, 1, "a" * 8), (1, 2, "b" * 8), (1, 3, "c" * 30)], "k int, i int, r string")
    parts = D.split_tables(t, "k", "i", "r", 1, 20).orderBy("part").collect()
    assert [p["text"] for p in parts] == ["head\n" + "a" * 8 + "\n" + "b" * 8, "head\n" + "c" * 30]
    caps = spark.createDataFrame([(1, "2", 1, "two"), (1, "2", 2, "again"), (1, "S1", 3, "extra")], "k int, figure string, position int, caption string")
    texts = spark.createDataFrame([(1, "Fig. S1, fig. 2")], "k int, t string")
    assert D.captions_for(texts, "k", "t", caps).first()["captions"] == "two\n\nextra"


def test_fuzzy_pairs(spark):
    draw = np.random.default_rng(4)
    base = [[f"w{i}" for i in draw.integers(0, 60, 40)] for _ in range(12)]
    near = [[*t[:10], "new", *t[12:]] for t in base[:8]]
    a = [" ".join(t) for t in base] + ["too short"]
    b = [" ".join(t) for t in near] + [" ".join(base[0])] + ["too short"]
    l = spark.createDataFrame([(i, 1, t) for i, t in enumerate(a)], "i int, g int, t string")
    r = spark.createDataFrame([(j, 1, t) for j, t in enumerate(b)], "j int, g int, t string")
    got = {(x["i"], x["j"]): x["score"] for x in D.fuzzy_pairs(l, r, "i", "j", ["g"], "t").collect()}
    assert set(got) == {(0, 8)} | {(i, i) for i in range(1, 8)}
    for (i, j), score in got.items():
        assert score == pytest.approx(SequenceMatcher(None, a[i].split(), b[j].split(), autojunk=False).ratio())


def test_fuzzy_pairs_of_many_copies(spark):
    same, other = (" ".join(f"{p}{i}" for i in range(40)) for p in "uv")
    near = other.replace("v7 ", "new ")
    left = [(i, 1, same) for i in range(60)] + [(100 + i, 1, other) for i in range(3)] + [(i, 2, same) for i in range(200, 204)]
    right = [(i, 1, same) for i in range(1000, 1058)] + [(1100 + i, 1, near) for i in range(4)] + [(i, 2, same) for i in range(1200, 1203)]
    l, r = spark.createDataFrame(left, "i int, g int, t string"), spark.createDataFrame(right, "j int, g int, t string")
    got = D.fuzzy_pairs(l, r, "i", "j", ["g"], "t").collect()
    want = {(i, 1000 + i) for i in range(58)} | {(100 + i, 1100 + i) for i in range(3)} | {(200 + i, 1200 + i) for i in range(3)}
    assert len(got) == len(want) and {(x["i"], x["j"]) for x in got} == want


def test_fuzzy_pairs_of_many_near_copies(spark):
    """Tied near copies that differ take no round of jobs for each pair, and result in what rounds would."""
    draw = np.random.default_rng(7)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:k], f"n{i}", *base[k + 1 :]]) for i, k in enumerate(draw.integers(0, 60, 70))]
    texts += [" ".join(t if draw.random() > p else f"o{draw.integers(0, 9)}" for t in base[::-1]) for p in draw.uniform(0.02, 0.3, 40)]
    a, b = texts[0::2], texts[1::2]
    l, r = (spark.createDataFrame([(i, 1, t) for i, t in enumerate(s)], "i int, g int, t string") for s in (a, b))
    spark.sparkContext.setJobGroup("near copies", "near copies")
    got = {(x["i"], x["j"]): x["score"] for x in D.fuzzy_pairs(l, r.withColumnRenamed("i", "j"), "i", "j", ["g"], "t").collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("near copies")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    left, want = {(i, j): SequenceMatcher(None, x.split(), y.split(), autojunk=False).ratio() for i, x in enumerate(a) for j, y in enumerate(b)}, {}
    left = {p: s for p, s in left.items() if s >= D.LEAST - D.MARGIN}
    while True:
        found = {}
        for (i, j), s in left.items():
            row, column = ([(-v, p[1 - k]) for p, v in left.items() if p[k] == (i, j)[k]] for k in (0, 1))
            second = max((-sorted(x)[1][0] for x in (row, column) if len(x) > 1), default=0.0)
            if min(row)[1] == j and min(column)[1] == i and s >= D.LEAST and (s >= D.SURE or s - second >= D.MARGIN):
                found[i, j] = s
        if not found:
            break
        want |= found
        gone = {i for i, _ in found}, {j for _, j in found}
        left = {p: s for p, s in left.items() if p[0] not in gone[0] and p[1] not in gone[1]}
    assert got == pytest.approx(want) and len(want) >= 35
    assert len(jobs) < 60


def _marked(draw, n=120):
    """Texts that share most of their tokens (five marks after each word), but in no common order."""
    return " ".join(f"w{draw.integers(0, 10**6)} {' '.join([draw.choice(list('$%&*'))] * 5)}" for _ in range(n))


def test_unrelated_texts_of_marks_are_not_compared_in_full(monkeypatch):
    from marlstone.operators import near_pairs

    draw, asked = np.random.default_rng(3), []
    texts = [_marked(draw) for _ in range(16)]
    near = " ".join(t if k % 40 else "new" for k, t in enumerate(texts[0].split(" ")))
    real = near_pairs.ratio
    monkeypatch.setattr(near_pairs, "ratio", lambda a, b: asked.append(1) or real(a, b))
    settling = near_pairs.Settling((texts[:8], [near, *texts[8:]]), D.LEAST, D.LEAST - D.MARGIN, D.SURE, D.MARGIN)
    assert sum(len(settling.bound(0, x)[0]) for x in range(8)) > 15  # multisets alone let them pass
    assert [x[:2] for x in settling.pairs()] == [(0, 0)] and len(asked) <= 2


def test_common_subsequence():
    from marlstone.operators import near_pairs

    draw = np.random.default_rng(6)
    for n, m, letters in ((1, 1, 2), (30, 50, 3), (200, 150, 5), (150, 200, 40), (257, 256, 2)):
        a, b = draw.integers(0, letters, n).tolist(), draw.integers(0, letters + 2, m).tolist()
        row = [0] * (m + 1)
        for x in a:
            old = row
            row = [0]
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(row[-1], old[j + 1]))
        for need in range(0, n + 1, max(1, n // 40)):
            assert near_pairs.common(near_pairs.masks(a), n, b, need) == (row[-1] if row[-1] >= need else -1)


def test_fuzzy_pairs_with_links_tested_again(spark, monkeypatch):
    """A large component's links are tested in parts, and what is left gives the same matches."""
    from marlstone.operators import near_pairs

    draw = np.random.default_rng(8)
    texts = [_marked(draw, 60) for _ in range(14)]
    pairs = [(t, " ".join(x if draw.random() > 0.03 else "new" for x in t.split(" "))) for t in texts[:6]]
    left = spark.createDataFrame([(i, 1, a) for i, (a, _) in enumerate(pairs)] + [(10 + i, 1, t) for i, t in enumerate(texts[6:10])], "i int, g int, t string")
    right = spark.createDataFrame([(j, 1, b) for j, (_, b) in enumerate(pairs)] + [(20 + j, 1, t) for j, t in enumerate(texts[10:])], "j int, g int, t string")
    match = lambda: {(x["i"], x["j"]): x["score"] for x in D.fuzzy_pairs(left, right, "i", "j", ["g"], "t").collect()}
    want = match()
    monkeypatch.setattr(near_pairs, "LARGE", 100)
    monkeypatch.setattr(near_pairs, "TEXTS", 3)
    written, table = [], D.Scratch.table
    monkeypatch.setattr(D.Scratch, "table", lambda self, df, name, *a: written.append(name) or table(self, df, name, *a))
    assert match() == want and set(want) == {(i, i) for i in range(6)} and "links" in written
    alone = near_pairs.links(pa.table({"__left": [True] * 6 + [False] * 6, "__node": list(range(12)), "__joined": [a for a, _ in pairs] + [b for _, b in pairs]}), D.LEAST - D.MARGIN)
    assert sorted(zip(alone["u"].to_pylist(), alone["v"].to_pylist())) == [(i, 6 + i) for i in range(6)]


def test_ratio_of_long_sequences():
    from marlstone.operators import near_pairs

    draw = np.random.default_rng(3)
    for n, v in ((400, 5), (700, 60), (1500, 400)):
        a = draw.integers(0, v, n).tolist()
        b = [x for t in a for x in ([t] if draw.random() > 0.06 else draw.integers(0, v, draw.integers(0, 3)).tolist())]
        assert near_pairs.ratio(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_table_tokens(spark):
    assert one(spark, D.table_tokens(F.col("v")), v="Ab 007 +1.50 -0 0.5 3.00 é x-2") == ["ab", "7", "1.5", "0", "0.5", "3", "x", "-2"]


def test_freundlich_flags(spark):
    rows = [(0.995, 0.5), (0.995, 1.5), (0.98, 0.2), (0.5, 0.5), (0.98, 1.0), (None, 0.5)]
    spike, dip = E.unstable_freundlich(F.col("f"), F.col("e"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "f double, e double").select(spike, dip).collect()]
    assert got == [(True, False), (False, True), (False, False), (False, False), (False, False), (False, False)]


def test_components_and_cover(spark):
    from marlstone.operators import graph

    e = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 99)], "u int, v int")
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert got == {i: 0 for i in range(31)} | {99: 99, 100: 99, 101: 99}
    cover = graph.set_cover(spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 3)], "set string, element int")).collect()
    assert [(r["set"], r["gained"]) for r in cover] == [("a", 2), ("b", 1)]


def test_upsert_refuses_overlap_and_repeats(spark):
    old = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "k int, s array<string>")
    new = spark.createDataFrame([(3, ["b", "a"]), (4, ["c", "d"]), (5, ["e"])], "k int, s array<string>")
    assert sorted((r["k"], r["action"]) for r in C.envelope_upsert(old, new, "k", "s").collect()) == [(2, "kept"), (3, "replaced"), (4, "refused"), (5, "appended")]
    with pytest.raises(ValueError):
        C.envelope_upsert(old.unionAll(old), new, "k", "s")


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("name,conc,unit\nA,1.5,mg/L\nB,x,mg/L\n,2,ug/L\nC,3,furlong\nD,4\n")
    good, bad = readers.checked_csv(spark, str(tmp_path / "m.csv"), "name string, conc double, unit string", ["name"], {"unknown unit": F.col("unit").isin("mg/L", "ug/L")})
    assert [tuple(r) for r in good.collect()] == [("A", 1.5, "mg/L")]
    assert {r["name"]: r["errors"] for r in bad.collect()} == {"B": ["conc is no double"], None: ["name is blank"], "C": ["unknown unit"], "D": ["wrong number of cells", "unknown unit"]}
    (tmp_path / "d.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="repeated"):
        readers.checked_csv(spark, str(tmp_path / "d.csv"), "a int", ["a"])
    (tmp_path / "l.jsonl").write_text('{"k": 1}\nnot json\n{"k": 2}\n')
    rows, lines = readers.read_json_lines(spark, str(tmp_path / "l.jsonl"), "k int")
    assert sorted(r["k"] for r in rows.collect()) == [1, 2] and [r["line"] for r in lines.collect()] == ["not json"]
    for i, status in enumerate(("ok", "failed")):
        folder = tmp_path / "art" / f"s{i}"
        folder.mkdir(parents=True)
        (folder / "x.json").write_text(json.dumps({"status": status, "outputs": [{"study_folder": f"s{i}", "file_type": "pdf", "chunk_id": "c", "extracted_data": {"t": {"records": [{"a": "1"}, {"b": "2"}]}}}]}))
    (tmp_path / "art" / "s2").mkdir()
    assert sorted((r["study"], r["position"], *r["record"].items()) for r in readers.read_artifacts(spark, str(tmp_path / "art"), ["t"]).collect()) == [("s0", 0, ("a", "1")), ("s0", 1, ("b", "2"))]
    for r in ("r1", "r2"):
        (tmp_path / r).mkdir()
        (tmp_path / r / "m.csv").write_text("fold,seed\n1,2\n")
    runs = spark.createDataFrame([("r1", str(tmp_path / "r1"), "completed", 7), ("r2", str(tmp_path / "r2"), "failed", 8), ("r3", str(tmp_path / "r3"), "completed", 9)], "run_id string, dir string, status string, seed int")
    assert [r.asDict() for r in readers.collect_runs(spark, runs, "dir", "m.csv").collect()] == [{"fold": "1", "seed": "2", "run_id": "r1", "run_seed": 7}]
    assert one(spark, readers.escaped_text(F.col("v")), v="=1+1") == "'=1+1"


def test_bundle_notices_changes(spark, tmp_path):
    at = str(tmp_path / "b")
    writers.write_bundle(spark, at, {"t": spark.range(5).toDF("i")}, {"by": "test"})
    assert writers.read_bundle(spark, at)[1]["t"].count() == 5
    spark.range(6).toDF("i").write.mode("overwrite").parquet(f"{at}/t")
    with pytest.raises(ValueError, match="changed"):
        writers.read_bundle(spark, at)


def test_append_is_idempotent(spark, tmp_path):
    at = str(tmp_path / "out")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert append.append_unseen(first, at, ["k"]) == 2
    assert append.append_unseen(first.unionAll(spark.createDataFrame([(3, "c")], "k int, v string")), at, ["k"]) == 1
    assert spark.read.parquet(at).count() == 3


def test_ordered_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "z int, b_1 int, a int, b_2 int")
    assert shape.ordered_columns(df, ["b_*"], ["z"]).columns == ["z", "b_1", "b_2", "a"]


@pytest.mark.parametrize("on_path", [False, True])
def test_entry_stands_without_the_corpus_folders(tmp_path, on_path):
    """A copy of the whole tree, corpus_pipeline.py included, without the two folders."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "__pycache__", ".git", ".pytest_cache"))
    env = os.environ | ({"PYTHONPATH": str(here)} if on_path else {})
    told = "import __spark_entry__ as e; print(len(e.queries()), any(k == 'pipeline' or k.startswith('op') and k[2].isdigit() for k in e.queries()))"
    for gone in (None, tmp_path / "r" / "corpus_pipeline.py"):
        if gone:
            gone.unlink(missing_ok=True)
        said = subprocess.run([sys.executable, "-c", told], cwd=tmp_path / "r", env=env, capture_output=True, text=True)
        assert said.returncode == 0, said.stderr
        assert said.stdout.split()[-1] == "False" and int(said.stdout.split()[-2]) > 100, said.stderr


def test_entry_stands_without_a_library_of_the_corpus_operators(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    told = "import sys; sys.modules['ahocorasick'] = None\nimport __spark_entry__ as e; print(len(e.queries()), 'op1_simhash' in e.queries())"
    here = Path(__file__).resolve().parent.parent
    said = subprocess.run([sys.executable, "-c", told], cwd=here, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.split()[-1] == "False", said.stderr
    assert "ahocorasick" in said.stderr or not (here / "marlstone" / "llm").is_dir()


@pytest.mark.parametrize("bandwidth", [None, 0.3])
def test_density_counts_every_training_row(spark, bandwidth):
    n = 5000
    x = np.random.default_rng(8).normal(size=(n, 2)) * [1, 20]
    q = np.concatenate([x[:50], x[:1], [[9.0, 300.0]]])
    table = lambda v: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(v)], "k long, a double, b double")
    z, y = x / x.std(axis=0, ddof=1), q / x.std(axis=0, ddof=1)
    h = bandwidth or (1 / n) ** (1 / 6) * 2.2
    plain = lambda p: np.array([np.maximum(1 - ((p[i] - z) ** 2).sum(axis=1) / h**2, 0).sum() for i in range(len(p))])
    top = plain(z).max()
    training = table(x)
    for rows, points in ((table(q), y), (training, z)):
        got = {r["k"]: r["dissimilarity"] for r in S.density_support(training, rows, "k", ["a", "b"], bandwidth).collect()}
        assert [got[i] for i in range(len(points))] == pytest.approx(np.clip(1 - plain(points) / top, 0, 1).tolist(), abs=1e-9)
    assert got and min(got.values()) == 0


def test_freundlich_balances_over_many_magnitudes():
    draw = np.random.default_rng(11)
    n = 200_000
    c0, dose, kf = 10 ** draw.uniform(-6, 4, n), 10 ** draw.uniform(-1, 4, n), 10 ** draw.uniform(-4, 3, n)
    ex = np.concatenate([draw.uniform(0.05, 0.1, n // 2), draw.uniform(0.1, 4, n - n // 2)])
    x = E.freundlich_root(c0, dose, kf, ex)
    assert not np.isnan(x).any() and (x > 0).all() and (x <= c0).all()
    assert (np.abs(x + dose / 1000 * kf * x**ex - c0) <= 1e-9 * c0).all()
    assert np.isnan(E.freundlich_root(*(np.array([v]) for v in (1.0, 1.0, -1.0, 1.0)))).all()
    assert np.isnan(E.freundlich_root(*(np.array([v]) for v in (1.0, 1.0, np.nan, 1.0)))).all()


def test_langmuir_keeps_its_digits(spark):
    """qm so large that the plain root of the quadratic is a difference of equal numbers."""
    df = spark.createDataFrame([(1.0, 25.0, 1e12, 1e3), (2.0, 25.0, 5.0, 0.5)], "c0 double, d double, qm double, kl double")
    for r in df.withColumn("ce", E.ce_langmuir(F.col("c0"), F.col("d"), F.col("qm"), F.col("kl"))).collect():
        assert abs(r.ce + r.d / 1000 * r.qm * r.kl * r.ce / (1 + r.kl * r.ce) - r.c0) <= 1e-10 * r.c0


def test_metrics_at_large_means(spark):
    draw = np.random.default_rng(1)
    y = 1e9 + draw.normal(size=400)
    g, w = y + draw.normal(size=400) * 0.01, draw.uniform(0.5, 2, 400)
    rows = [("a", float(a), float(b), float(c)) for a, b, c in zip(y, g, w)] + [(None, 1.0, 2.0, 1.0), (None, 3.0, 3.0, 1.0), ("b", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, y double, g double, w double")
    for weights, column in ((np.ones(400), None), (w, "w")):
        got = {r["k"]: r for r in A.regression_by(df, ["k"], "y", "g", column).collect()}
        want = 1 - np.average((y - g) ** 2, weights=weights) / np.average((y - np.average(y, weights=weights)) ** 2, weights=weights)
        assert got["a"]["r2"] == pytest.approx(want, abs=1e-9)
        assert got[None]["n"] == 2 and got[None]["r2"] == pytest.approx(0.5) and got["b"]["n"] == 0 and got["b"]["r2"] is None


def test_ranks_and_quantiles_by_ranges(spark):
    from marlstone.operators import ranks
    from marlstone.operators.tables import Scratch

    draw = np.random.default_rng(3)
    rows = [(["a", "b", None][i % 3], float(v)) for i, v in enumerate(draw.integers(0, 40, 500))] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for k in ("a", "b", None):
        own = sorted(v for g, v in rows if g == k and v is not None)
        got = {r["v"]: r["rank"] for r in ranks.average_ranks(df, ["k"], "v", Scratch(spark), "x").collect() if r["k"] == k}
        assert got == {v: np.mean([i + 1 for i, x in enumerate(own) if x == v]) for v in own}
        q = {r["k"]: r["q"] for r in ranks.quantiles(df, ["k"], "v", [0, 0.05, 0.5, 0.77, 1]).collect()}[k]
        assert q == pytest.approx(np.quantile(own, [0, 0.05, 0.5, 0.77, 1]).tolist())
    whole = ranks.quantiles(df, [], "v", [0.5]).collect()
    assert whole[0]["q"] == pytest.approx([np.median([v for _, v in rows if v is not None])])
    shares = A.cumulative_share(spark.createDataFrame([("x", 3, 1), ("x", 1, 2), ("x", 1, 3), (None, 5, 4)], "k string, n long, i long"), "n", "i", ["k"]).collect()
    assert sorted((r["i"], r["place"], round(r["running"], 6)) for r in shares) == [(1, 1, 0.6), (2, 2, 0.8), (3, 3, 1.0), (4, 1, 1.0)]


def test_retry_takes_what_passes(monkeypatch):
    from marlstone.sources import readers

    seen = []

    def read():
        seen.append(1)
        if len(seen) < 3:
            raise RuntimeError("java.io.IOException: connection reset")
        return "rows"

    assert readers.with_retry(read, wait=0) == "rows" and len(seen) == 3
    with pytest.raises(RuntimeError, match="PATH_NOT_FOUND"):
        readers.with_retry(lambda: (_ for _ in ()).throw(RuntimeError("[PATH_NOT_FOUND] java.io.IOException")), wait=0)


def plain_greedy(rows, threshold):
    out = []
    for g in {r[0] for r in rows}:
        used = set(), set()
        for _, a, b, s in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1], r[2])):
            if s >= threshold and a not in used[0] and b not in used[1]:
                used[0].add(a)
                used[1].add(b)
                out.append((g, a, b, s))
    return sorted(out)


def test_assignment_in_rounds_is_the_greedy_one(spark):
    from marlstone.operators import documents as D

    draw = np.random.default_rng(4)
    seen = {}
    for _ in range(900):
        seen[int(draw.integers(3)), int(draw.integers(25)), int(draw.integers(25))] = float(draw.integers(12))
    rows = [(*k, v) for k, v in seen.items()]
    df = spark.createDataFrame(rows, "g int, a int, b int, s double").repartition(4)
    got = sorted(tuple(r) for r in D.greedy_assignment(df, "g", "a", "b", "s", 3.0).collect())
    assert got == plain_greedy(rows, 3.0)
    assert D.greedy_assignment(df.limit(0), "g", "a", "b", "s", 3.0).count() == 0


def test_global_assignment_query_is_the_greedy_one(spark):
    import duckdb

    from marlstone import plans

    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT l_returnflag, l_suppkey, l_partkey, round(sum(l_quantity), 2) FROM '{sf}/lineitem.parquet' GROUP BY 1, 2, 3").fetchall()
    got = sorted(tuple(r) for r in plans.queries()["global_assignment"](spark, sf).collect())
    assert got == plain_greedy(rows, 20.0) and got


def test_subset_sums_are_the_closest():
    from itertools import product

    draw = np.random.default_rng(5)
    for _ in range(60):
        classes = [(int(s), int(n)) for s, n in {int(draw.integers(1, 30)): int(draw.integers(1, 5)) for _ in range(draw.integers(1, 6))}.items()]
        want = int(draw.integers(0, sum(s * n for s, n in classes) + 1))
        got = S._subset(classes, want)
        assert all(0 <= got.get(s, 0) <= n for s, n in classes) and set(got) <= {s for s, _ in classes}
        total = sum(s * k for s, k in got.items())
        best = min(abs(sum(s * k for (s, _), k in zip(classes, ks)) - want) for ks in product(*[range(n + 1) for _, n in classes]))
        assert abs(total - want) == best
    assert S._subset([], 0) == {}


def test_size_matched_holdout_takes_whole_groups(spark):
    rows = [(g,) for g in range(40) for _ in range(g % 7 + 1)]
    out = S.size_matched_holdout(spark.createDataFrame(rows, "u int"), "u", 0.3).collect()
    sides = {}
    for r in out:
        sides.setdefault(r["u"], set()).add(r["split"])
    assert all(len(s) == 1 for s in sides.values()) and len(out) == len(rows)
    assert sum(r["split"] == "test" for r in out) == round(0.3 * len(rows))


def test_holdout_bound_by_prefixes(spark):
    from hashlib import md5

    units = spark.range(3000).selectExpr("id as u")
    order = sorted(md5(f"split|{i}".encode()).hexdigest() for i in range(3000))
    for k in (1, 2, 1500, 3000):
        assert S.kth_draw(units, "u", "split", k) == order[k - 1]


def test_pair_holdout_keeps_every_component(spark):
    draw = np.random.default_rng(6)
    pairs = sorted({(int(a), int(b)) for a, b in draw.integers(0, 12, (80, 2))})
    rows = S.pair_holdout(spark.createDataFrame(pairs * 2, "a int, b int"), "a", "b", 0.25).collect()
    side = {(r["a"], r["b"]): r["split"] for r in rows}
    assert len(rows) == 2 * len(pairs) and set(side) == set(pairs)
    for i in (0, 1):
        assert {p[i] for p, s in side.items() if s == "training"} == {p[i] for p in pairs}
    assert sum(s == "test" for s in side.values()) <= np.ceil(0.25 * len(pairs))


def test_folds_exchange_groups_of_equal_size(spark):
    """All groups have the same size, so no single move is allowed, but exchanges even out the strata."""
    rows = [(u, "x" if u < 6 else "y") for u in range(12) for _ in range(5)]
    df = spark.createDataFrame(rows, "u int, s string")

    def worst(d):
        counts = {}
        for r in d.collect():
            counts[r["fold"], r["s"]] = counts.get((r["fold"], r["s"]), 0) + 1
        return sum(abs(counts.get((f, s), 0) / 30 - 0.5) for f in (0, 1) for s in "xy")

    before, after = S.balanced_folds(df, "u", 2), S.evidence_balanced_folds(df, "u", "s", 2)
    assert worst(after) <= worst(before) and worst(after) < 1e-9 + (0 if worst(before) < 0.7 else 0.4)
    assert {r["n"] for r in after.groupBy("fold").count().withColumnRenamed("count", "n").collect()} == {30}


def test_refresh_stops_where_nothing_is_safe(spark):
    from marlstone.operators import match as M

    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "y")], "old int, k string, t string")
    fresh = spark.createDataFrame([(10, "a", "changed"), (11, "d", "y"), (12, "e", "y")], "new int, k string, t string")
    got = sorted(tuple(r) for r in M.refresh_lineage(old, fresh, ["k"], ["t"], "old", "new").collect())
    assert got == [(1, 10, "source_key"), (2, 11, "content"), (3, 12, "content")]
    with pytest.raises(ValueError, match="without an old one.*13"):
        M.refresh_lineage(old, fresh.unionAll(spark.createDataFrame([(13, "f", "z")], fresh.schema)), ["k"], ["t"], "old", "new")
    with pytest.raises(ValueError, match="repeated source keys among old"):
        M.refresh_lineage(old.unionAll(old.limit(1)), fresh, ["k"], ["t"], "old", "new")


def test_suggestions_are_the_close_matches(spark):
    from difflib import get_close_matches

    from marlstone.operators import match as M

    names = ["Filtrasorb 400", "Filtrasorb 300", "Amberlite IRA910", "Amberlite XAD4", "Purolite A592", "filter sand", "Calgon F400", None]
    asked = ["Filtrasorb 410", "Amberlite", "nothing alike 99", None]
    rows = M.suggestions(spark.createDataFrame([(a,) for a in asked], "k string"), "k", spark.createDataFrame([(n,) for n in names], "n string"), "n", block=3).collect()
    assert {r["k"]: r["suggestions"] for r in rows} == {a: get_close_matches(a, [n for n in names if n], 5, 0.45) for a in asked if a}


def test_tables_are_cut_by_cells(spark):
    from marlstone.operators import documents as D

    lines = ["| a | b |", *[f"| {i} | x |" for i in range(7)]]
    df = spark.createDataFrame([("t", i, r) for i, r in enumerate(lines)] + [("u", 0, "| only | head |")], "k string, i int, r string")
    parts = sorted((r["k"], r["part"], r["text"].count("\n")) for r in D.split_tables(df, "k", "i", "r", 1, 10_000, 6).collect())
    assert parts == [("t", 0, 3), ("t", 1, 3), ("t", 2, 1), ("u", 0, 0)]
    assert D.split_tables(df, "k", "i", "r", 1, 10_000, 6, (1000, 100)).count() == 2


def test_density_query_against_all_rows(spark):
    from marlstone import plans

    sf = "/root/testdata/sf0.001"
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", "p_retailprice").toPandas()
    z = p[["p_size", "p_retailprice"]].to_numpy(float)
    z = z / z.std(axis=0, ddof=1)
    h = (1 / len(z)) ** (1 / 6) * 2.2
    v = np.array([np.maximum(1 - ((x - z) ** 2).sum(axis=1) / h**2, 0).sum() for x in z])
    got = {r["p_partkey"]: r["dissimilarity"] for r in plans.queries()["density_support"](spark, sf).collect()}
    assert [got[k] for k in p["p_partkey"]] == pytest.approx((1 - v / v.max()).tolist(), abs=1e-8)


def test_audits_handle_nulls_and_empty_tables(spark):
    from marlstone.operators import audit

    df = spark.createDataFrame([("a", 1.0, None, "x", 1), ("a", None, 2.0, " ", 2), (None, 3.0, 3.0, "y", 3), (None, 5.0, 1.0, None, 4)], "k string, v double, w double, t string, i int")
    for rows in (df, df.limit(0)):
        c = audit.consolidate(rows, "k", ["v", "w"], ["t"], "i").collect()
        audit.residual_audit(rows, "k", "i", "v", "w").collect()
        audit.representative(rows, ["k"], ["v", "w"], ["i"]).collect()
        audit.review_queue(rows, "k", "v", 1, 4, extra={"w": 2}).collect()
        audit.mixture_ranking(rows, "k", "i", "v", source="t").collect()
        audit.pool_tokens(rows, ["k"], F.split("t", " "), F.col("i") > 0, "all").collect()
        assert len(c) == (2 if rows is df else 0)
    one = {r["k"]: r for r in audit.consolidate(df, "k", ["v"], ["t"], "i").collect()}
    assert (one["a"]["v"], one["a"]["v_range"], one["a"]["t"], one[None]["v"], one[None]["v_range"], one[None]["v_n_studies"]) == (1.0, "1.0", "x", 4.0, "3.0-5.0", 2)


def test_strict_import_of_quoted_headers(spark, tmp_path):
    from marlstone.sources import readers

    at = tmp_path / "a.csv"
    at.write_text('"name, full",v,n\n"x, y",1.5,3\nz,nan,4\n"say ""hi""",2,x\nq,1\n')
    good, bad = readers.checked_csv(spark, str(at), "`name, full` string, v double, n int", ["v"], most_bytes=1000)
    assert [tuple(r) for r in good.collect()] == [("x, y", 1.5, 3)]
    assert sorted(r["errors"] for r in bad.collect()) == [["n is no int"], ["v is no double"], ["wrong number of cells"]]
    with pytest.raises(ValueError, match="bytes"):
        readers.checked_csv(spark, str(at), "v double", ["v"], most_bytes=5)
    at.write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="repeated columns: a"):
        readers.checked_csv(spark, str(at), "a int", [])


def test_scenarios(spark, tmp_path):
    from marlstone.sources import readers

    at = tmp_path / "s.csv"
    at.write_text("Compound,Dose (mg/L),pH\nPFOA,25,7\nPFOS,,8\n,5,x\n")
    how = ("compound string, dose double, ph double", ["compound", "dose"], {"dose": ["Dose (mg/L)"]})
    good, bad = readers.read_scenarios(spark, str(at), *how, checks={"dose is not positive": F.col("dose").try_cast("double") > 0})
    assert [(r["compound"], r["dose"], r["ph"], r["row"]) for r in good.collect()] == [("PFOA", 25.0, 7.0, 1)]
    assert sorted((r["row"], r["errors"]) for r in bad.collect()) == [("2", ["dose is blank", "dose is not positive"]), ("3", ["compound is blank", "ph is no double"])]
    at.write_text("compound,dosage\nx,1\n")
    with pytest.raises(ValueError, match="unknown columns: dosage"):
        readers.read_scenarios(spark, str(at), *how)


def test_moved_runs_are_found(spark, tmp_path):
    from marlstone.sources import readers

    for name, text in (("r1", "a,b\n1,2\n"), ("moved/r2", "b,c\n3,4\n"), ("r3", "")):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "m.csv").write_text(text)
    runs = spark.createDataFrame([("1", f"{tmp_path}/r1", "completed", "x"), ("2", f"{tmp_path}/r2", "completed", "y"), ("3", f"{tmp_path}/r3", "completed", "z"), ("4", f"{tmp_path}/r1", "failed", "w")], "run_id string, folder string, status string, b string")
    out = readers.collect_runs(spark, runs, "folder", "m.csv", base=f"{tmp_path}/moved").collect()
    assert sorted((r["run_id"], r["a"], r["b"], r["c"], r["run_b"]) for r in out) == [("1", "1", "2", None, "x"), ("2", None, "3", "4", "y")]


def test_reference_dose_query_by_bisection(spark):
    """Every row of the query again, in plain Python: roots by halving, the choice by the rules."""
    from marlstone import plans
    from marlstone.plans import endpoint_plans

    sf = "/root/testdata/sf0.001"
    c = F.col
    rows = endpoint_plans._rows(spark, sf).withColumns({"logkd": E.log10(E.kd_from_removal(c("f"), c("d"))), "source": F.when(c("l_linenumber") % 2 == 0, "Freundlich").otherwise("Removal")})
    got = sorted((r["l_orderkey"], r["l_linenumber"], r["ref_basis"], r["ref_logkd"]) for r in plans.queries()["reference_dose"](spark, sf).collect())

    def halved(took, c0):
        low, high = 0.0, c0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if middle + took(middle) < c0 else (low, middle)
        return (low + high) / 2

    want = []  # order and line number don't tell rows apart
    for r in rows.collect():
        fits, key = {}, (r["l_orderkey"], r["l_linenumber"])
        for name, r2, q in (("Langmuir", r["r2l"], lambda x: r["qm"] * r["kl"] * x / (1 + r["kl"] * x)), ("Freundlich", r["r2f"], lambda x: r["kf"] * x ** r["ex"])):
            if r2 >= 0.90:
                ce = halved(lambda x: 0.025 * q(x), r["c0"])
                if ce > 0:
                    fits[name] = r2, np.log10(q(ce) / ce)
        basis = r["source"] if r["source"] in fits else max(fits, key=lambda k: (fits[k][0], k == "Langmuir")) if fits else None
        if basis:
            want.append((*key, basis, float(fits[basis][1])))
        elif abs(r["d"] - 25) <= 5 and r["logkd"] is not None:
            want.append((*key, "observed_dose_within_tolerance", r["logkd"]))
    want.sort()
    assert [g[:3] for g in got] == [w[:3] for w in want] and len(got) > 100
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-6)


def test_components_of_features_by_entity(spark):
    """One record per entity (its first value that is there); the least missing feature of a component stays."""
    draw = np.random.default_rng(12)
    rows = []
    for e in range(40):
        a = float(draw.normal())
        for i in range(3):
            rows.append((f"e{e}", 3 * e + i, None if i == 0 else a, (2 * a + 1) if e % 4 else None, float(draw.normal()), -a, a if i else float("nan")))
    df = spark.createDataFrame(rows, "e string, i int, a double, b double, c double, d double, x double").repartition(4)
    got = {r["feature"]: tuple(r)[1:] for r in S.prune_components(df, ["b", "a", "c", "d", "x"], {"a": "m", "b": "m", "c": "m", "d": "m", "x": "n"}, {"m": "e"}, "i").collect()}
    assert {k: (v[0], v[1], v[2], v[4]) for k, v in got.items()} == {"b": ("m", "corr_m_001", "a", True), "a": ("m", "corr_m_001", "a", False), "d": ("m", "corr_m_001", "a", True), "c": ("m", None, "c", False), "x": ("n", None, "x", False)}
    screened = {r["feature"]: r["reason"] for r in S.screen_features(df, ["a", "b", "c", "d", "gone"], "e", most_missing=0.2, bucket={"d": "water"}, excluded_buckets=["water"]).collect()}
    assert screened == {"a": "too many missing", "b": "too many missing", "c": None, "d": "excluded bucket", "gone": "missing column"}


def test_rank_association_needs_pairs_and_variety(spark):
    from marlstone.operators import audit

    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 3.0), ("a", None, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 1.0, 5.0), ("c", 1.0, 6.0), ("c", 1.0, 7.0)]
    got = [(r["g"], r["pairs"], round(r["spearman"], 9)) for r in audit.rank_association(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()]
    assert got == [("a", 3, 0.5)]


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_set_cover_is_the_greedy_one(spark, monkeypatch, few):
    from marlstone.operators import graph

    monkeypatch.setattr(graph, "FEW", few)
    draw = np.random.default_rng(13)
    pairs = sorted({(int(a), int(b)) for a, b in draw.integers(0, 14, (70, 2))})
    left, want = {}, []
    for s, e in pairs:
        left.setdefault(s, set()).add(e)
    while any(left.values()):
        s = min(left, key=lambda k: (-len(left[k]), k))
        want.append((s, len(want) + 1, len(left[s])))
        gone = set(left[s])
        left = {k: v - gone for k, v in left.items()}
    df = spark.createDataFrame(pairs + pairs[:5] + [(None, 1), (2, None)], "set int, element int")
    assert [tuple(r) for r in graph.set_cover(df).collect()] == want
    assert graph.set_cover(df.limit(0)).count() == 0


def test_one_use_each_streams_and_takes_missing_indexes(spark):
    draw = np.random.default_rng(3)
    rows = [(int(g) if g else None, i, None if i % 17 == 0 else int(a), int(b), 6, None if i % 29 == 0 else 6) for i, (g, a, b) in enumerate(draw.integers(-1, 7, (400, 3)))]
    df = spark.createDataFrame(rows, "g long, i long, a long, b long, n int, m int").repartition(3)
    used, want = {}, {}
    for g, i, a, b, n, m in rows:
        x, y = used.setdefault(g, (set(), set()))
        if None in (a, b, n, m) or not (0 <= a < n and 0 <= b < m):
            want[i] = "out of range"
        elif a in x or b in y:
            want[i] = "used"
        else:
            want[i] = "ok"
            x.add(a)
            y.add(b)
    got = D.one_use_each(df, "g", "i", "a", "b", "n", "m")
    assert {tuple(r) for r in got.collect()} == {(*r, want[r[1]]) for r in rows} and set(want.values()) == {"ok", "used", "out of range"}
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_histogram_holds_no_column_in_a_task(spark):
    df = spark.createDataFrame([(float(v),) for v in range(100)] + [(None,)], "v double")
    out = A.histogram(df, "v", 40)
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["bin"]: r["n"] for r in out.collect()} == {**{b: 20 for b in range(4)}, 4: 21}
    same = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert {r["bin"]: r["n"] for r in A.histogram(same, "v", 40).collect()} == {3: 3}


def test_alias_pairs_exchange_classes_only(spark):
    draw = np.random.default_rng(6)
    side = lambda n: [(int(i), [None if x == 5 else f"a{x}" for x in row]) for i, row in zip(draw.integers(0, n, n), draw.integers(0, 12, (n, 3)))]
    a, b = [*side(60), (None, ["a1"]), (99, [])], [*side(40), (98, None)]
    ids = lambda rows: {k: {x for j, own in rows if j == k for x in own or [] if x} for k, _ in rows}
    want = {(i, j, len(x & y)) for i, x in ids(a).items() for j, y in ids(b).items() if x & y}
    schema = "k long, a array<string>"
    got = M.alias_pairs(spark.createDataFrame(a, schema), "k", "a", spark.createDataFrame(b, schema).withColumnRenamed("k", "j"), "j", "a")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert "Aggregate [k" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_density_meets_near_cells_only(spark):
    """60,000 rows on a line of 3,000 points: by blocks of all rows these were 3.6 thousand million pairs."""
    df = spark.range(60_000).select("id", (F.col("id") % 3000).cast("double").alias("a"))
    out = S.density_support(df, df, "id", ["a"], 0.01)
    x = np.arange(3000) / np.std(np.arange(60_000) % 3000, ddof=1)
    v = np.array([20 * np.maximum(1 - ((p - x) / 0.01) ** 2, 0).sum() for p in x])
    got = {r["id"]: r["dissimilarity"] for r in out.collect()}
    assert len(got) == 60_000 and [got[i] for i in range(3000, 6000)] == pytest.approx((1 - v / v.max()).tolist(), abs=1e-9)


@pytest.mark.parametrize("few", [12, 30])
def test_set_cover_takes_many_sets_a_round(spark, monkeypatch, few):
    from marlstone.operators import graph

    pairs = sorted({(int(a), int(b)) for a, b in np.random.default_rng(14).integers(0, 30, (90, 2))})
    want = graph._cover(pairs, 0)[0]
    monkeypatch.setattr(graph, "FEW", few)
    rounds, cover = [], graph._cover
    monkeypatch.setattr(graph, "_cover", lambda *a: rounds.append(a) or cover(*a))
    assert [tuple(r) for r in graph.set_cover(spark.createDataFrame(pairs, "set int, element int")).collect()] == want
    assert 1 < len(rounds) < len(want)
