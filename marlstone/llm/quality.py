"""Quality rules: statistics of a text, and an isolation forest that marks texts with odd ones.

Statistics (words are runs without the six white-space bytes). Base: word_chars, n_symbols, n_dup_lines and
n_repeat_words as in `statistics`; a document fails the base rules if it has fewer than `min_words` words or
more than half of its words repeat. The forest sees rates of these and of further rule statistics (capitals,
marks of exclamation); repeats and different words are counted within windows of some `WINDOW` words and
averaged over all windows of the text, so they don't drift with its length.

Forest. Trees split random statistics at random points over small draws of labelled clean documents (DRAW rows a
tree, which is the isolation forest's own definition; each draw is from all of them); a document that ends after few
splits is unlike them. Its score is the mean path length over all trees. The threshold is set on rows that the trees
have not seen: a labelled clean row counts with its mean path over the trees that it was not drawn for, junk is in no
draw. Of all thresholds that keep at least `keep` of the clean rows, the one with the best rate of junk caught less
LOSS times the rate of clean rows lost. All labelled documents count: the trees' box, the draws, the rates and the
threshold are taken from tables of their statistics, of which only the drawn rows reach the driver. Every document is
scored. Without labels of both kinds, the base rules decide alone.

Edge cases. Null and empty texts: no words, base_failed. Very long texts: one text's words stand in memory once;
of `LONG` words and more, three-word windows are told apart by 64-bit hashes, eight bytes each. Null or repeated
doc_id: each row is judged.
Labels: null labels and rows whose text is missing are left out; of repeated labels each counts. Empty
tables: no rows, or base rules alone. `filter_documents` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import running
from .common import Scratch, ranked
from .words import shingle_hashes

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_letters", "n_exclaims")
#: Means over a text's windows, in millionths: the share of repeats squared, and different words by words ** 0.9.
NEAR = ("near_repeat", "near_distinct")
#: What the forest splits on, see `rates`.
RATES = ("word_length", "symbols", "near_repeat", "capitals", "exclaims", "near_distinct")
WINDOW, LONG = 1024, 1 << 16
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])


def _repeats(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    if len(words) >= LONG:
        hashed = np.concatenate(list(shingle_hashes(words, 3, 0)))
        _, which, times = np.unique(hashed, return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[which] > 1)
        marked = np.zeros(len(words), bool)
        for k in range(3):
            marked[at + k] = True
        return int(marked.sum())
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, repeated, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            repeated += i + 3 - max(upto, i)
            upto = i + 3
    return repeated


def statistics(text: str | None) -> tuple[int, ...]:
    """BASE, MORE and NEAR of a text.

    word_chars: code points in words. n_symbols: characters of `#*$%&|<>`. n_dup_lines: lines with a word
    that equal an earlier line. n_repeat_words: words that stand in a three-word window found twice or more.
    Letters and capitals are ASCII.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, without = raw.split(), lambda kinds: len(raw) - len(raw.translate(None, kinds))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, repeated = len(words), _repeats(words)
    k = max(1, round(n / WINDOW))
    cuts = [n * i // k for i in range(k + 1)]
    parts = [words[a:b] for a, b in zip(cuts, cuts[1:])] if k > 1 else [words]
    near_repeat = sum(((_repeats(p) if k > 1 else repeated) / max(1, len(p))) ** 2 for p in parts) / k if repeated else 0.0
    near_distinct = sum(len(set(p)) / max(1, len(p)) ** 0.9 for p in parts) / k
    return (
        n, len(text or "") - without(_SPACE), without(_SYMBOLS), len(lines) - len(set(lines)), repeated,
        without(_UPPER), without(_LETTERS), raw.count(b"!"), round(near_repeat * 1e6), round(near_distinct * 1e6),
    )


def rates(s: np.ndarray) -> np.ndarray:
    """Rows of statistics -> rows of what the forest splits on. The share of repeats is squared, as a few say
    little; repeated lines have no column of their own, as clean documents hold licence and header lines twice and what
    is made of such lines shows in the other columns."""
    n_words, word_chars, n_symbols, _, _, n_upper, n_letters, n_excl, near_repeat, near_distinct = s.T.astype(float)
    n = np.maximum(n_words, 1)
    return np.stack([word_chars / n, n_symbols / n, near_repeat / 1e6, n_upper / np.maximum(n_letters, 1), n_excl / n, near_distinct / 1e6], axis=1)


def _expected(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays (tree, node): the node's feature (-1: leaf), split, left child and path length if it ends here."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    length: np.ndarray
    threshold: float = 0.0

    def path(self, x: np.ndarray, seen: list[np.ndarray] | None = None) -> np.ndarray:
        """Mean path length; with `seen` (per tree the rows of x that it was grown on), over the other trees."""
        total, trees = np.zeros(len(x)), np.zeros(len(x))
        for i, (feature, split, child, length) in enumerate(zip(self.feature, self.split, self.child, self.length)):
            at = np.zeros(len(x), np.int64)
            while (going := np.nonzero(feature[at] >= 0)[0]).size:
                node = at[going]
                at[going] = child[node] + (x[going, feature[node]] > split[node])
            counts = np.ones(len(x))
            if seen is not None:
                counts[seen[i]] = 0
            total += length[at] * counts
            trees += counts
        return total / np.maximum(trees, 1)


#: Trees (with few labels a clean row's path is the mean over a third of them, and over 33 it was too noisy for a
#: threshold), rows of a tree's draw, and splits on a path, at most.
TREES, DRAW, DEPTH = 300, 256, 12


def _tree(own: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
    """A tree over a draw of clean rows. A node splits at random within its box, cut from the box of all labelled rows;
    so a side of it where no clean row is ends the path at once."""
    feature, split, child, length, wide = [-1], [0.0], [0], [0.0], np.nonzero(high > low)[0]
    todo = [(0, own, low.copy(), high.copy(), 0)]
    while todo:
        node, at, lo, hi, deep = todo.pop()
        length[node] = deep + float(_expected(len(at)))
        if len(at) <= 1 or deep >= depth or not len(wide):
            continue
        f = int(draw.choice(wide))
        s = float(draw.uniform(lo[f], hi[f]))
        right = at[:, f] > s
        feature[node], split[node], child[node] = f, s, len(feature)
        feature += [-1, -1]
        split += [0.0, 0.0]
        child += [0, 0]
        length += [0.0, 0.0]
        up, down = hi.copy(), lo.copy()
        up[f], down[f] = s, s
        todo += [(child[node], at[~right], lo, up, deep + 1), (child[node] + 1, at[right], down, hi, deep + 1)]
    return np.array(feature), np.array(split), np.array(child), np.array(length)


def _rows_of_a_draw(clean: int, rows: int) -> int:
    return min(rows, max(1, 2 * clean // 3))


def grow(clean: np.ndarray, everything: np.ndarray, trees: int = TREES, rows: int = DRAW, depth: int = DEPTH, seed: int = 9) -> tuple[Forest, list[np.ndarray]]:
    """A forest over draws of at most two thirds of the clean rows, and the rows of each draw."""
    draw, drawn = np.random.default_rng(seed), []
    low, high, built = everything.min(axis=0), everything.max(axis=0), []
    for _ in range(trees):
        drawn.append(draw.permutation(len(clean))[: _rows_of_a_draw(len(clean), rows)])
        built.append(_tree(clean[drawn[-1]], low, high, depth, draw))
    return Forest(*[list(x) for x in zip(*built)]), drawn


#: How much worse it is to lose a clean document than to keep a bad one.
LOSS = 4.0


#: The part of clean labelled rows that the forest must keep; the base rules.
KEEP, MIN_WORDS, MAX_REPEAT = 0.99, 50, 50


def _base_failed(s: np.ndarray, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> np.ndarray:
    return (s[:, 0] < min_words) | (100 * s[:, 4] > max_repeat * s[:, 0])


def _statistics_of(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts], np.int64).reshape(-1, len(BASE) + len(MORE) + len(NEAR))


def _with_statistics(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """doc_id and __s, the statistics, of every row, as a table."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("__s", T.ArrayType(T.LongType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(_statistics_of(b.column(1))), pa.list_(pa.int64()))], names=schema.names)

    return scratch.table(rows.mapInArrow(each, schema), "statistics")


def _rows_of(lists: pa.Array, kind: type) -> np.ndarray:
    return np.array(lists.to_pylist(), kind).reshape(len(lists), -1)


def _threshold(paths: DataFrame, good: int, bad: int, keep: float, scratch: Scratch) -> float:
    """Of paths(__path, __good, 0 or 1): the threshold that catches most and loses least, and keeps at least `keep` of
    the good rows."""
    line = running(paths, [], ["__path", "__good"], "__good", scratch, "paths")
    line = line.groupBy("__path").agg((F.min("__before") / good).alias("lost"), (F.min(F.col("__pos") - F.col("__before")) / bad).alias("caught"))
    line = scratch.table(line.withColumn("value", F.when(F.col("lost") <= 1 - keep, F.col("caught") - LOSS * F.col("lost")).otherwise(-LOSS)), "cuts")
    best = line.orderBy(F.desc("value"), "__path").first()["__path"]
    below = line.where(F.col("__path") < best).agg(F.max("__path")).first()[0]
    return best - 1 if below is None else (below + best) / 2


def _fit(own: DataFrame, labels: DataFrame, id_col: str, label_col: str, keep: float, scratch: Scratch, seed: int = 9) -> Forest | None:
    """From the statistics (doc_id, __s) of all labelled rows. Those that fail the base rules are out already and teach
    nothing. The driver gets the rows of the draws only, TREES x DRAW at most."""
    labelled = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("__good")).where("doc_id is not null and __good is not null")
    rows = own.join(labelled, "doc_id").select(F.col("doc_id").cast("string").alias("__id"), (F.col("__good") == 1).cast("int").alias("__good"), "__s")

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _rows_of(b.column(2), np.int64)
            stay = np.flatnonzero(~_base_failed(s)) if len(s) else np.zeros(0, np.int64)
            if len(stay):
                b = b.take(pa.array(stay))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(rates(s[stay])), pa.list_(pa.float64()))], names=["__id", "__good", "__x"])

    # in an order of their own, the bad rows after the good ones: a draw is a set of positions
    rows = ranked(rows.mapInArrow(rated, "__id string, __good int, __x array<double>"), [], [F.desc("__good"), F.xxhash64("__id"), "__id", "__x"], "__pos", "__all", scratch, "labelled")
    rows = rows.select("__good", "__x", "__pos")
    box = [f(F.get("__x", F.lit(i))) for f in (F.min, F.max) for i in range(len(RATES))]
    good, everything, *ends = rows.agg(F.sum("__good"), F.count(F.lit(1)), *box).first()
    if not good or good == everything:
        return None
    draw = np.random.default_rng(seed)
    drawn = [np.sort(draw.choice(good, _rows_of_a_draw(good, DRAW), replace=False)) for _ in range(TREES)]
    places, number = np.unique(np.concatenate(drawn), return_inverse=True)
    trees_of = np.zeros((len(places), TREES), bool)
    trees_of[number, np.repeat(np.arange(TREES), [len(d) for d in drawn])] = True

    def is_drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(np.isin(b.column(0).to_numpy(), places)))

    found = rows.select("__pos", "__x").mapInArrow(is_drawn, "__pos long, __x array<double>").toArrow().sort_by("__pos")
    x = _rows_of(found["__x"].combine_chunks(), float)  # in the order of places
    low, high = np.array(ends[: len(RATES)]), np.array(ends[len(RATES) :])
    forest = Forest(*[list(x) for x in zip(*[_tree(x[np.searchsorted(places, d)], low, high, DEPTH, draw) for d in drawn])])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column(2).to_numpy()
            near = np.minimum(np.searchsorted(places, at), len(places) - 1)
            seen = trees_of[near] & (places[near] == at)[:, None]
            path = forest.path(_rows_of(b.column(1), float), [np.flatnonzero(seen[:, t]) for t in range(TREES)])
            yield pa.RecordBatch.from_arrays([pa.array(path), b.column(0)], names=["__path", "__good"])

    paths = rows.select("__good", "__x", "__pos").mapInArrow(walked, "__path double, __good int")
    return replace(forest, threshold=_threshold(paths, good, everything - good, keep, scratch))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: float = KEEP) -> Forest | None:
    """The forest of all labelled rows."""
    scratch = Scratch(docs.sparkSession)
    return _fit(_with_statistics(docs, id_col, text_col, scratch), labels, id_col, label_col, keep, scratch)


def _kept(s: np.ndarray, forest: Forest | None) -> tuple[np.ndarray, np.ndarray]:
    failed = _base_failed(s)
    kept = ~failed
    if forest and kept.any():
        kept[kept] = forest.path(rates(s[kept])) >= forest.threshold
    return failed, kept


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: float = KEEP) -> DataFrame:
    """Per row: doc_id, the base statistics, base_failed and kept. Texts are read once, for a table of statistics."""
    scratch = Scratch(docs.sparkSession)
    rows = _with_statistics(docs, id_col, text_col, scratch)
    forest = _fit(rows, labels, id_col, label_col, keep, scratch)
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in BASE], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _rows_of(b.column(1), np.int64) if b.num_rows else np.zeros((0, len(BASE) + len(MORE) + len(NEAR)), np.int64)
            failed, kept = _kept(s, forest)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(s[:, i]) for i in range(len(BASE))], pa.array(failed), pa.array(kept)], names=schema.names)

    return rows.mapInArrow(each, schema)


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: float = KEEP) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Statistics are taken twice, as whole rows don't go into a table."""
    forest = fit_on(docs, labels, id_col, text_col, label_col, keep)

    @F.arrow_udf(T.BooleanType())
    def keeps(texts: pa.Array) -> pa.Array:
        return pa.array(_kept(_statistics_of(texts), forest)[1])

    return docs.where(keeps(F.col(text_col).cast("string")))
