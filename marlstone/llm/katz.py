"""Language-model scores: Katz backoff over n-grams up to `order`, learnt from the training documents.

Model. Words are lower-cased (A-Z); a document is its words and one end, each scored given the order - 1 tokens
before (the first given starts, which are never scored). At each order, counts up to 5 are discounted by
Good-Turing as Katz has it; if the counts of counts don't allow it (small corpora), by a constant n1 / (n1 + 2 n2);
the column `discounting` says which, order by order. Words: what the discounts leave goes to one unknown word.
Higher orders: P(w|h) = d r / c(h) for a seen n-gram, else alpha(h) P(w|h') with h' one word shorter, and
alpha(h) = (1 - sum of seen P(w|h)) / (1 - sum of their P(w|h')), so that each context's probabilities add up to 1
over the vocabulary and the unknown word. A context none of whose n-grams is discounted would leave nothing; its
denominator is c(h) + 1. A context without training tokens backs off in full.

Execution. Documents are cut into blocks of about two million tokens, kept as packed arrays. Order by order, a
block asks for the counts of its different n-grams, with their training counts in the block and what it knows of
their suffixes. Requests go to partitions by a hash of the context, in FAN rows a block. They add up the counts,
write them as the model's tables, work out the contexts' backoff weights and answer. If FAN partitions would be too
large, requests are first merged by groups of FAN blocks, which send FAN rows each again, and answers come back the
same way: so rows are in proportion to blocks, however many partitions there are. A context that one block alone
holds needs no request: all its n-grams are in the block, which is their table. No table is broadcast but the
statistics of contexts that hold a 1/HOT share of all tokens each: at most HOT of an order, 65,536 at most. Their
n-grams are dealt by n-gram and not by context, so no partition holds a frequent context. Very long documents span
blocks. Words and contexts are told apart by 64-bit hashes.

Edge cases. Null and empty texts: the end alone. Null doc_id: a training row. Repeated rows: each counts and
is scored. No training rows: N and V are 0, every score is 0 (the unknown word has it all). Empty table: no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from .common import Scratch
from .words import hashes, lower_words

ORDER, BLOCK, K = 3, 2_000_000, 5
#: Rows that a block sends for one order, and tokens for which there shall be a partition.
FAN, PARTITION = 64, 4_000_000
_END = np.uint64(xxh64_intdigest(b" end", 0))  # no word has a space
_START_ID = np.uint64(1 << 63)

BODY, ANSWER, TABLE, CONTEXT, SUMS, WORDS, LOST = range(7)  # LOST: the part of an answer that only scoring needs
_ROWS = "key long, kind int, source long, data binary, stats array<double>"
_COLUMNS = [c.split()[0] for c in _ROWS.split(", ")]


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays in the narrowest kind, compressed."""
    out = {}
    for name, a in arrays.items():
        if a.dtype.kind == "b":
            a = (len(a), np.packbits(a))
        elif a.dtype.kind in "iu" and len(a):
            a = a.astype(np.min_scalar_type(int(a.max())))
            if a.itemsize > 1:  # bytes of equal weight side by side
                a = (a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T))
        out[name] = a
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out, 5))


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    out = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    for k, a in out.items():
        if isinstance(a, tuple):
            out[k] = np.unpackbits(a[1], count=a[0]).astype(bool) if isinstance(a[0], int) else np.ascontiguousarray(a[1].T).view(a[0]).reshape(-1)
    return out


def _rise(a: np.ndarray) -> np.ndarray:
    """A sorted array as its steps."""
    return np.diff(a, prepend=a.dtype.type(0))


def _row(key: int, kind: int, source: int, data: bytes | None, stats: list | None = None) -> tuple:
    return key, kind, source, data, stats


def _table(rows: list[tuple]) -> pa.Table:
    schema = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("source", pa.int64()), ("data", pa.binary()), ("stats", pa.list_(pa.float64()))])
    columns = list(zip(*rows)) or [()] * 5
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _different(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different codes and each row's place among them."""
    bits = max(1, len(code) - 1).bit_length()
    if not len(code) or int(code.max()).bit_length() + bits > 63:
        return np.unique(code, return_inverse=True)
    packed = np.sort(code.astype(np.int64) << bits | np.arange(len(code)))  # sorting values is far faster than places
    code, place = packed >> bits, packed & ((1 << bits) - 1)
    fresh = np.empty(len(code), bool)
    fresh[0] = True
    np.not_equal(code[1:], code[:-1], out=fresh[1:])
    inverse = np.empty(len(code), np.int64)
    inverse[place] = np.cumsum(fresh) - 1
    return code[fresh], inverse


def _ordered(code: np.ndarray) -> np.ndarray:
    """np.argsort, by values where they leave room for the places."""
    bits = max(1, len(code) - 1).bit_length()
    if not len(code) or int(code.max()).bit_length() + bits > 63:
        return np.argsort(code, kind="stable")
    return np.sort(code << bits | np.arange(len(code))) & ((1 << bits) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _part(hashed: np.ndarray, parts: int) -> np.ndarray:
    """Of `parts` equal ranges of 64-bit hashes the one of each; grows with the hash."""
    return ((hashed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def blocks(rows: DataFrame, order: int = ORDER, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """rows(__id, __held, __text) as blocks, two rows each: key, kind (BODY or WORDS), n (tokens), opens (training
    documents that begin there), data, ids. WORDS has sorted hashes and training counts; BODY refers to their places."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, made, row = TaskContext.get().partitionId() << 32, 0, 0
        held, size = [], 0

        def cut() -> pa.RecordBatch:
            nonlocal made
            tokens = np.concatenate([p[3] for p in held])
            lens = np.array([len(p[3]) for p in held], np.int64)
            before = np.concatenate([p[4] for p in held])  # of pieces that go on: the order - 1 tokens before
            words, local = np.unique(np.concatenate([tokens, before]), return_inverse=True)
            is_held, goes_on = np.array([p[2] for p in held], bool), np.array([len(p[4]) > 0 for p in held], bool)
            counts = np.bincount(local[: len(tokens)][~np.repeat(is_held, lens)], minlength=len(words))
            per_part = np.bincount(_part(words, fan), minlength=fan)  # words are sorted, so each partition's are a stretch
            body = _pack(tokens=local[: len(tokens)], before=local[len(tokens) :], goes_on=goes_on, lens=lens, held=is_held, rows=np.array([p[0] for p in held], np.int64), parts=np.array([p[5] for p in held], bool), per_part=per_part)
            ids = pa.array([p[1] for p in held], rows_type).to_pylist()
            made += 1
            key, n, opens = place + made, len(tokens), int((~is_held & ~goes_on).sum())
            columns = [pa.array([key] * 2), pa.array([BODY, WORDS], pa.int32()), pa.array([n, 0]), pa.array([opens, 0]), pa.array([body, _pack(words=_rise(words), counts=counts)], pa.binary()), pa.array([ids, None], pa.list_(rows_type))]
            return pa.RecordBatch.from_arrays(columns, names=["key", "kind", "n", "opens", "data", "ids"])

        for b in batches:
            rows_type = b.column(0).type
            for id_, is_held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own = np.append(hashes(lower_words(text.as_py()), 0), _END)
                row += 1
                for i in range(0, len(own), block):
                    part = own[i : i + block]
                    held.append((place + row, id_, is_held, part, own[i - order + 1 : i] if i else own[:0], len(own) > block))
                    size += len(part)
                    if size >= block:
                        yield cut()
                        held, size = [], 0
        if held:
            yield cut()

    kinds = [("key", T.LongType()), ("kind", T.IntegerType()), ("n", T.LongType()), ("opens", T.LongType()), ("data", T.BinaryType()), ("ids", T.ArrayType(rows.schema["__id"].dataType))]
    return rows.mapInArrow(each, T.StructType([T.StructField(*k) for k in kinds]))


def discounts(n: np.ndarray) -> tuple[np.ndarray, str]:
    """Factors for counts 0..K (0: unused) from n[r], how many types have count r, for r up to K + 1; and their name."""
    d = np.ones(K + 1)
    if all(n[1 : K + 2] > 0):
        common = (K + 1) * n[K + 1] / n[1]
        r = np.arange(1, K + 1)
        good = ((r + 1) * n[2 : K + 2] / n[1 : K + 1] / r - common) / (1 - common) if common != 1 else np.zeros(K)
        if ((good > 0) & (good < 1)).all():
            d[1:] = good
            return d, "good-turing"
    off = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 and n[2] > 0 else 0.5
    d[1:] = 1 - off / np.arange(1, K + 1)
    return d, "absolute"


def _discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(r <= K, d[np.minimum(r, K)], 1.0) * r


class Words:
    """P(w) by w's training count; count 0 is the unknown word."""

    def __init__(self, total: int, types: int, n: np.ndarray):
        self.total, self.types = total, types
        self.d, self.name = discounts(n)
        low = n[1 : K + 1] * np.arange(1, K + 1)
        kept = float((low * self.d[1:]).sum() + total - low.sum())
        self.over = float(total) if kept < total or not total else total + 1.0
        self.unknown = 1.0 - kept / self.over if total else 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, _discounted(counts, self.d) / max(self.over, 1.0), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.types + 1)))


class Model:
    """What the driver knows: sizes, discounts and the statistics of hot contexts by order."""

    def __init__(self, order: int, total: int, docs: int, blocks: int, hot: int):
        self.order, self.total, self.docs, self.blocks, self.share = order, total, docs, blocks, hot
        self.words: Words | None = None
        self.d: dict[int, np.ndarray] = {}
        self.hot: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def is_hot(self, totals: np.ndarray) -> np.ndarray:
        return totals.astype(np.int64) * self.share >= self.total

    def lower(self, n: int, counts: np.ndarray, over: np.ndarray | None) -> np.ndarray:
        """P of seen n-grams of order n by their counts and their contexts' denominators."""
        return self.words.p(counts) if n == 1 else _discounted(counts, self.d[n]) / over


def _stats(context: np.ndarray, r: np.ndarray, lower: np.ndarray, n: int) -> np.ndarray:
    """Of each of n contexts: types with count 1..K, tokens above K, and the sum of their seen words' lower P.

    P is rounded to 52 bits behind the point, so that sums up to 1 are exact and the same in every order."""
    seen, stats, lower = r > 0, np.zeros((n, K + 2)), np.rint(lower * 2.0**52) / 2.0**52
    for i in range(1, K + 1):
        stats[:, i - 1] = np.bincount(context[r == i], minlength=n)
    stats[:, K] = np.bincount(context[r > K], r[r > K], minlength=n)
    stats[:, K + 1] = np.bincount(context[seen], lower[seen], minlength=n)
    return stats


def _alpha(stats: np.ndarray, totals: np.ndarray, d: np.ndarray, least: float) -> np.ndarray:
    over = np.where(stats[:, :K].sum(axis=1) > 0, totals, totals + 1).astype(float)
    kept = (stats[:, :K] * (d[1:] * np.arange(1, K + 1))).sum(axis=1) + stats[:, K]
    return (1 - kept / over) / np.maximum(1 - stats[:, K + 1], least)


def _sums(r: np.ndarray) -> list[float]:
    n = np.bincount(np.minimum(r[r > 0], K + 2), minlength=K + 3)
    return [float(x) for x in (r.sum(), (r > 0).sum(), *n[1 : K + 2])]


# Requests and answers. A word request has sorted `words` (hashes) and `counts`. One of a higher order has contexts, given
# by their words' ids u0, u1, ... and sorted by these, with `totals` (and `overs`, their suffixes' denominators) and `runs`
# of entries; an entry has its word's `place` among `words` (ids), its suffix's count `low` and its training count `train`.
# `many`: more than one block asks. Frequent words have small ids, so that ids pack well.


def _ids(a: dict) -> list[str]:
    return [k for k in ("u0", "u1", "u2", "u3", "u4", "u5", "u6", "u7") if k in a]


def _context_hash(ids: list[np.ndarray]) -> np.ndarray:
    out = _mix(ids[0])
    for x in ids[1:]:
        out = _next_hash(out, x)
    return out


def _next_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(context * np.uint64(0x2545F4914F6CDD1D) + word.astype(np.uint64))


def _merge_words(asked: list[dict]) -> tuple[dict, list[np.ndarray]]:
    sizes = [len(a["words"]) for a in asked]
    every, inverse = np.unique(np.concatenate([a["words"] for a in asked]), return_inverse=True)
    times = np.bincount(inverse, np.concatenate([1.0 + a["many"] for a in asked]))
    counts = np.bincount(inverse, np.concatenate([a["counts"] for a in asked])).astype(np.int64)
    return {"words": every, "counts": counts, "many": times > 1}, np.split(inverse, np.cumsum(sizes)[:-1])


def _merge(asked: list[dict]) -> tuple[dict, list[np.ndarray]]:
    names = _ids(asked[0])
    contexts, c_first, c_of = np.unique(np.concatenate([a["contexts"] for a in asked]), return_index=True, return_inverse=True)
    ids = [np.concatenate([a[k] for a in asked])[c_first] for k in names]
    order = np.lexsort(ids[::-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    contexts, c_of = contexts[order], place[c_of]
    words, w_of = np.unique(np.concatenate([a["words"] for a in asked]), return_inverse=True)
    out, codes, c_at, w_at = {"contexts": contexts, "words": words} | {k: x[order] for k, x in zip(names, ids)}, [], 0, 0
    for a in asked:
        c, w = c_of[c_at : c_at + len(a["contexts"])], w_of[w_at : w_at + len(a["words"])]
        c_at, w_at = c_at + len(c), w_at + len(w)
        codes.append(np.repeat(c, a["runs"]) * len(words) + w[a["place"]])
    every, inverse = _different(np.concatenate(codes))
    for name in ("totals", "overs"):
        if name in asked[0]:
            out[name] = np.zeros(len(contexts), np.int64)
            out[name][c_of] = np.concatenate([a[name] for a in asked])
    out["runs"], out["place"] = np.bincount(every // max(1, len(words)), minlength=len(contexts)), every % max(1, len(words))
    out["low"] = np.zeros(len(every), np.int64)
    out["low"][inverse] = np.concatenate([a["low"] for a in asked])
    out["train"] = np.bincount(inverse, np.concatenate([a["train"] for a in asked]), len(every)).astype(np.int64)
    out["many"] = np.bincount(inverse, np.concatenate([1.0 + a["many"] for a in asked]), len(every)) > 1
    return out, np.split(inverse, np.cumsum([len(c) for c in codes])[:-1])


def _wide(a: dict) -> dict:
    """A request as it is worked on."""
    out = {k: x.astype(np.uint64 if k == "words" or k in _ids(a) else np.int64) if x.dtype.kind in "iu" else x for k, x in a.items()}
    out |= {k: np.cumsum(out[k]) for k in ("u0", "words") if k in out}
    return out | ({"contexts": _context_hash([out[k] for k in _ids(out)])} if "u0" in out else {})


def _narrow(a: dict) -> bytes:
    return _pack(**({k: x for k, x in a.items() if k != "contexts"} | {k: _rise(a[k]) for k in ("u0", "words") if k in a}))


def _routes(a: dict, model: Model) -> np.ndarray:
    """Of each entry of a request the hash that decides on its partition."""
    if "runs" not in a:
        return a["words"]
    context = np.repeat(a["contexts"], a["runs"])
    return np.where(np.repeat(model.is_hot(a["totals"]), a["runs"]), _mix(context + a["words"][a["place"]]), context)


def _split(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its entries in order)."""
    order = _ordered(part)
    ends = np.flatnonzero(np.diff(part[order], append=-1)) + 1
    for i, j in zip([0, *ends[:-1].tolist()], ends.tolist()):
        yield int(part[order[i]]), order[i:j]


def _sent(a: dict, parts: int, model: Model | None) -> Iterator[tuple[int, bytes]]:
    """A request as one for each partition that it concerns."""
    if not len(a["many"]):
        return
    context = np.repeat(np.arange(len(a["contexts"])), a["runs"]) if "runs" in a else None
    for p, at in _split(_part(_routes(a, model), parts)):
        if context is None:
            yield p, _narrow({k: x[at] for k, x in a.items()})
            continue
        of = context[at]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        c = of[first]
        w, place = _different(a["place"][at])
        out = {k: a[k][c] for k in ("totals", "overs", *_ids(a)) if k in a} | {"runs": np.diff(first, append=len(at)), "words": a["words"][w], "place": place}
        yield p, _narrow(out | {k: a[k][at] for k in ("low", "train", "many")})


def _answer(r: np.ndarray, alone: np.ndarray, whole: np.ndarray) -> bytes:
    return _pack(r=r, alone=alone, whole=whole)


def _lost(lost_of: np.ndarray, stats: np.ndarray) -> bytes:
    """lost_of: of each entry the row of `stats` with its context's statistics, or -1."""
    is_lost = lost_of >= 0
    rows, which = np.unique(lost_of[is_lost], return_inverse=True)
    slim = stats[rows]
    return _pack(is_lost=is_lost, which=which, low=slim[:, : K + 1].astype(np.int64).ravel(), seen=slim[:, K + 1])


def _lost_read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = _unpack(data)
    lost_of = np.full(len(a["is_lost"]), -1, np.int64)
    lost_of[a["is_lost"]] = a["which"]
    return lost_of, np.concatenate([a["low"].reshape(-1, K + 1).astype(float), a["seen"].reshape(-1, 1)], axis=1)


def _count_words(key: int, parts: int, every: dict) -> tuple[list[tuple], dict]:
    known = every["counts"] > 0
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(-every["counts"], kind="stable")] = np.arange(len(known))
    uid = np.where(known, rank * parts + key + 1, 0)
    rows = [_row(key, TABLE, 0, _pack(words=_rise(every["words"][known]), counts=every["counts"][known])), _row(key, SUMS, 0, None, _sums(every["counts"]))]
    return rows, {"uid": uid, "count": every["counts"], "alone": ~every["many"]}


def _count(key: int, n: int, model: Model, every: dict) -> tuple[list[tuple], dict]:
    context, r, contexts = np.repeat(np.arange(len(every["contexts"])), every["runs"]), every["train"], len(every["contexts"])
    lower = np.zeros(len(r))
    seen = r > 0  # the suffixes of seen n-grams are seen
    lower[seen] = model.lower(n - 1, every["low"][seen], every["overs"][context[seen]] if n > 2 else None)
    stats, hot = _stats(context, r, lower, contexts), model.is_hot(every["totals"])
    rows = [_row(key, TABLE, 0, _model_table([every[k][context[seen]] for k in _ids(every)], every["words"][every["place"][seen]], r[seen])), _row(key, SUMS, 0, None, _sums(r))]
    rows += [_row(int(every["contexts"][i].astype(np.int64)), CONTEXT, key, None, stats[i].tolist()) for i in np.flatnonzero(hot)]
    whole = (stats[:, :K].sum(axis=1) == 0) & ~hot
    return rows, {"r": r, "alone": ~every["many"], "whole": whole[context], "lost_of": np.where((r == 0) & ~hot[context], context, -1), "stats": stats}


def _model_table(contexts: list[np.ndarray], words: np.ndarray, counts: np.ndarray) -> bytes:
    """Seen n-grams by context: the contexts' word ids, how many n-grams each has, their last words and counts."""
    fresh = np.zeros(len(words), bool)
    fresh[:1] = True
    for x in contexts:
        fresh[1:] |= x[1:] != x[:-1]
    opens = np.flatnonzero(fresh)
    ids = {f"u{i}": x[opens] for i, x in enumerate(contexts)}
    return _pack(**(ids | {"u0": _rise(ids["u0"])}), runs=np.diff(opens, append=len(words)), words=words, counts=counts)


def _told(key: int, source: int, answer: dict, at: np.ndarray) -> list[tuple]:
    """The rows that answer a request's entries."""
    if "uid" in answer:
        return [_row(source, ANSWER, key, _pack(**{k: x[at] for k, x in answer.items()}))]
    rows = [_row(source, ANSWER, key, _answer(answer["r"][at], answer["alone"][at], answer["whole"][at]))]
    if (answer["lost_of"][at] >= 0).any():
        rows.append(_row(source, LOST, key, _lost(answer["lost_of"][at], answer["stats"])))
    return rows


def _requests(table: pa.Table, merge) -> tuple[list[int], dict, list[np.ndarray]]:
    """Sources in order, their requests merged, and each one's entries among these. (Other rows of the table aside.)"""
    rows = sorted((s, i) for i, (s, k) in enumerate(zip(table["source"].to_pylist(), table["kind"].to_pylist())) if k == 0)
    asked = [_wide(_unpack(table["data"][i].as_py())) for _, i in rows]
    return [s for s, _ in rows], *(merge(asked) if asked else ({}, []))


def _reducer(n: int, parts: int, model: Model):
    def reduce(table: pa.Table) -> pa.Table:
        key = table["key"][0].as_py()
        sources, every, own = _requests(table, _merge if n > 1 else _merge_words)
        if not sources:  # a block's own sums
            return table.select(_COLUMNS)
        rows, answer = _count(key, n, model, every) if n > 1 else _count_words(key, parts, every)
        return _table(rows + [x for s, at in zip(sources, own) for x in _told(key, s, answer, at)])

    return reduce


def _combiner(n: int, inner: int, model: Model):
    """Requests of a group of blocks for one of the outer partitions -> one request for each of its inner ones."""

    def combine(table: pa.Table) -> pa.Table:
        group = table["group"][0].as_py()
        _, every, _ = _requests(table, _merge if n > 1 else _merge_words)
        return _table([_row(p, 0, group, data) for p, data in _sent(every, inner, model)])

    return combine


def _expander(n: int, inner: int, model: Model):
    """The same requests with the answers of the inner partitions -> answers to the group's blocks."""

    def expand(table: pa.Table) -> pa.Table:
        bucket = table["key"][0].as_py()
        sources, every, own = _requests(table, _merge if n > 1 else _merge_words)
        got = {(k, s): d.as_py() for s, k, d in zip(table["source"].to_pylist(), table["kind"].to_pylist(), table["data"]) if k}
        size, whole, stats, offset = len(every["train" if n > 1 else "words"]), {}, [], 0
        for p, at in _split(_part(_routes(every, model), inner)):
            a = {k: x.astype(np.int64) if x.dtype.kind in "iu" else x for k, x in _unpack(got[ANSWER, p]).items()}
            if n > 1:
                a["lost_of"], own_stats = _lost_read(got[LOST, p]) if (LOST, p) in got else (np.full(len(at), -1, np.int64), np.zeros((0, K + 2)))
                a["lost_of"] = np.where(a["lost_of"] >= 0, a["lost_of"] + offset, -1)
                offset += len(own_stats)
                stats.append(own_stats)
            for k, x in a.items():
                whole.setdefault(k, np.zeros(size, x.dtype))[at] = x
        if n > 1:
            whole["stats"] = np.concatenate(stats)
        return _table([x for s, at in zip(sources, own) for x in _told(bucket, s, whole, at)])

    return expand


def _levels(tokens: int, partition: int, fan: int) -> list[int]:
    """How many partitions each level of merging has: the outer ones fan, fan * fan, ..."""
    out = [fan]
    while out[-1] * partition < tokens:
        out.append(min(out[-1] * fan, -(-tokens // partition // out[-1]) * out[-1]))
    return out


def _exchange(asks: DataFrame, n: int, sources: int, levels: list[int], model: Model, scratch: Scratch, name: str, fan: int) -> DataFrame:
    """asks(key: outer partition, kind 0, source, data) -> answers (key: source, source: outer partition), tables, sums and
    hot contexts, as a written table by kind. Every row goes to a partition of its own key's."""
    if len(levels) == 1:
        dealt = asks.repartition(max(1, levels[0]), "key")
        return scratch.table(dealt.groupBy("key").applyInArrow(_reducer(n, levels[0], model), _ROWS), name, ["kind"])
    groups, here = max(1, -(-sources // fan)), levels[0]  # sources: that may ask one partition
    asks = scratch.table(asks, f"{name}_asks", ["kind"])
    tables, asks = asks.where("kind <> 0").select(*_COLUMNS), asks.where("kind = 0")
    in_group = F.pmod(F.xxhash64("source"), F.lit(groups)) * here + F.col("key")
    grouped = asks.withColumn("group", in_group)
    merged = grouped.repartition(groups * here, "group").groupBy("group").applyInArrow(_combiner(n, levels[1], model), _ROWS)
    found = _exchange(merged, n, groups, levels[1:], model, scratch, f"{name}_{len(levels)}", fan)
    back = found.where(f"kind in ({ANSWER}, {LOST})").select((F.col("key") % here).alias("key"), "kind", "source", "data", "stats", F.col("key").alias("group"))
    both = grouped.select("key", "kind", "source", "data", "stats", "group").unionByName(back)
    answers = both.repartition(groups * here, "group").groupBy("group").applyInArrow(_expander(n, levels[1], model), _ROWS)
    return scratch.table(answers.unionByName(found.where(f"kind not in ({ANSWER}, {LOST})").select(*_COLUMNS)).unionByName(tables), name, ["kind"])


class Level:
    """A block's different n-grams of one order: their contexts and suffixes (n-grams one order lower), and counts."""

    def __init__(self, of: np.ndarray, context: np.ndarray, word: np.ndarray, suffix: np.ndarray, train: np.ndarray):
        self.of, self.context, self.word, self.suffix, self.train = of, context, word, suffix, train
        self.hashed = self.rank = self.count = self.alone = self.over = self.p = None


class Block:
    """A block's n-grams of all orders that are answered, and the requests of the next."""

    def __init__(self, body: bytes, answers: dict[int, dict[tuple[int, int], bytes]], model: Model, fan: int, scoring: bool):
        self.model, self.fan, self.scoring = model, fan, scoring
        self.__dict__ |= {k: a.astype(np.int64) if a.dtype.kind in "iu" else a for k, a in _unpack(body).items()}
        lead, stretch = model.order - 1, np.cumsum(self.per_part)
        self.start, self.levels = int(stretch[-1]), []
        ends = np.cumsum(self.lens + lead)
        self.first = ends - self.lens
        word = np.full(int(ends[-1]), self.start, np.int32)
        inside = np.ones(len(word), bool)  # positions of tokens; before each piece stand the order - 1 tokens before it
        for k in range(lead):
            inside[ends - self.lens - 1 - k] = False
            word[(self.first - lead + k)[self.goes_on]] = self.before[k::lead] if lead else 0
        word[inside] = self.tokens
        self.inside, self.word = inside, word
        self.trains = np.zeros(len(word), bool)
        self.trains[inside] = ~np.repeat(self.held, self.lens)
        one = Level(word, np.zeros(0, np.int64), np.arange(self.start + 1), np.zeros(0, np.int64), np.zeros(0, np.int64))
        uid, one.count, one.alone = (np.zeros(self.start + 1, k) for k in (np.uint64, np.int64, bool))
        for (_, q), data in answers.get(1, {}).items():
            got, at = _unpack(data), slice(int(stretch[q] - self.per_part[q]), int(stretch[q]))
            uid[at], one.count[at], one.alone[at] = got["uid"], got["count"], got["alone"]
        uid[-1], one.count[-1], one.alone[-1] = _START_ID, model.docs, model.blocks == 1
        self.uid, one.hashed, self.by_uid, self.word_rank = uid, _mix(uid), np.argsort(uid, kind="stable"), np.empty(len(uid), np.int32)
        self.word_rank[self.by_uid] = np.arange(len(uid))
        one.rank = self.word_rank
        one.p = model.words.p(one.count) if scoring else None
        self.levels.append(one)
        for n in range(2, max(answers, default=0) + 1):
            self.settle(n, self.grow(n), answers[n])

    def grow(self, n: int) -> Level:
        """The block's n-grams of order n, not yet answered."""
        low, valid = self.levels[-1], np.ones(len(self.word), bool)
        lead = self.model.order - 1
        for k in range(n - 1):
            valid[(self.first - lead + k)] = False
        at = np.flatnonzero(valid)
        code, inverse = _different(low.of[at - 1].astype(np.int64) * (self.start + 1) + self.word[at])
        of = np.full(len(self.word), -1, np.int32)
        of[at] = inverse
        suffix = np.zeros(len(code), np.int32)
        suffix[inverse] = low.of[at]
        context, word = np.divmod(code, self.start + 1)
        return Level(of, context.astype(np.int32), word.astype(np.int32), suffix, np.bincount(inverse[self.trains[at]], minlength=len(code)).astype(np.int32))

    def ranked(self, level: Level, low: Level) -> None:
        """Adds the hashes of a level's n-grams and their places by word ids, for the requests of the next."""
        level.hashed = _next_hash(low.hashed[level.context], self.uid[level.word])
        level.rank = np.empty(len(level.word), np.int32)
        level.rank[_ordered(low.rank[level.context].astype(np.int64) * len(self.uid) + self.word_rank[level.word])] = np.arange(len(level.word))

    def request(self, n: int, level: Level) -> tuple[dict, np.ndarray]:
        """The request for what other blocks may hold too, and its entries' n-grams."""
        low = self.levels[-1]
        opens = level.word == self.start  # starts alone: no n-gram, but a context whose count is known
        asked = np.flatnonzero((low.count[level.context] > 0) & ~low.alone[level.context] & ~opens)
        asked = asked[_ordered(low.rank[level.context[asked]].astype(np.int64) * len(self.uid) + self.word_rank[level.word[asked]])]
        context = level.context[asked]
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(asked) else np.zeros(0, np.int64)
        words, place = _different(self.word_rank[level.word[asked]])
        words = self.uid[self.by_uid[words]]  # unknown words are all 0
        out, of = {"contexts": low.hashed[context[first]]}, context[first]
        for k in range(n - 2, -1, -1):  # a context's words, from its last to its first
            step = self.levels[k]
            out[f"u{k}"] = self.uid[step.word[of]] if k else self.uid[of]
            of = step.context[of] if k else of
        out |= {"totals": low.count[context[first]].astype(np.int64), "runs": np.diff(first, append=len(asked)), "words": words, "place": place}
        out |= {"low": low.count[level.suffix[asked]], "train": level.train[asked], "many": np.zeros(len(asked), bool)}
        if n > 2:  # all suffixes of a context's n-grams have one context and so one denominator, where they are seen
            out["overs"] = np.maximum.reduceat(low.over[level.suffix[asked]], first).astype(np.int64) if len(asked) else first
        return out, asked

    def alone(self, level: Level) -> np.ndarray:
        """n-grams whose context no other block holds."""
        low = self.levels[-1]
        return (low.count[level.context] > 0) & low.alone[level.context] & (level.word != self.start)

    def settle(self, n: int, level: Level, answers: dict[tuple[int, int], bytes]) -> None:
        """Takes in the answers; where scores are wanted, with their LOST part, P of each n-gram too."""
        low, model, size, scoring = self.levels[-1], self.model, len(level.context), self.scoring
        request, asked = self.request(n, level)
        own = self.alone(level)
        total = low.count[level.context]
        level.count, level.alone, whole = np.zeros(size, np.int32), np.zeros(size, bool), np.zeros(size, bool)
        if n < model.order:
            self.ranked(level, low)
        level.count[own], level.alone[own] = level.train[own], True
        below, alpha = (low.p[level.suffix], np.ones(size)) if scoring else (None, None)
        d = model.d.get(n)
        if own.any():
            contexts, of = _different(level.context[own])
            r = level.train[own]
            whole[own] = (np.bincount(of[(r > 0) & (r <= K)], minlength=len(contexts)) == 0)[of]
            if scoring:
                alpha[own] = _alpha(_stats(of, r, below[own], len(contexts)), low.count[contexts], d, model.words.unknown)[of]
        for q, at in _split(_part(_routes(request, model), self.fan)) if len(asked) else ():
            got, grams = _unpack(answers[ANSWER, q]), asked[at]
            level.count[grams], level.alone[grams], whole[grams] = got["r"], got["alone"], got["whole"]
            if scoring and (LOST, q) in answers:
                lost_of, stats = _lost_read(answers[LOST, q])
                is_lost = lost_of >= 0
                rows = lost_of[is_lost]
                totals = np.zeros(len(stats), np.int64)
                totals[rows] = total[grams[is_lost]]
                alpha[grams[is_lost]] = _alpha(stats, totals, d, model.words.unknown)[rows]
        hot = asked[model.is_hot(total[asked])]
        if len(hot):
            ids, stats = model.hot[n]
            place = np.searchsorted(ids, low.hashed[level.context[hot]])
            whole[hot] = stats[place, :K].sum(axis=1) == 0
            if scoring:
                alpha[hot] = _alpha(stats[place], total[hot], d, model.words.unknown)
        level.over = total + whole
        if scoring:
            seen = level.count > 0
            below *= np.where(total > 0, alpha, 1.0)
            below[seen] = _discounted(level.count[seen], d) / level.over[seen]
            level.p = below
        opens = level.word == self.start
        level.count[opens], level.alone[opens] = model.docs, model.blocks == 1
        level.train = low.rank = low.hashed = low.alone = low.over = low.p = None  # not asked for again
        self.levels.append(level)


def _block_of(table: pa.Table, upto: int, model: Model, fan: int, scoring: bool) -> Block:
    answers: dict[int, dict[tuple[int, int], bytes]] = {n: {} for n in range(1, upto + 1)}
    body = None
    for n, kind, source, data in zip(table["n"].to_pylist(), table["kind"].to_pylist(), table["source"].to_pylist(), table["data"]):
        if kind != BODY:
            answers[n][kind, source] = data.as_py()
        else:
            body = data.as_py()
    return Block(body, answers, model, fan, scoring)


def _ask_words(fan: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, packed in zip(b.column(0).to_pylist(), b.column(1)):
                own = _unpack(packed.as_py())
                words = np.cumsum(own["words"], dtype=np.uint64)
                a = {"words": words, "counts": own["counts"], "many": np.zeros(len(words), bool)}
                rows = [_row(q, 0, key, data) for q, data in _sent(a, fan, None)]
                yield from _table(rows).to_batches()

    return each


def _asker(n: int, model: Model, fan: int):
    def each(table: pa.Table) -> pa.Table:
        block, key = _block_of(table, n - 1, model, fan, False), table["key"][0].as_py()
        level = block.grow(n)
        request, _ = block.request(n, level)
        rows = [_row(q, 0, key, data) for q, data in _sent(request, fan, model)]
        own = block.alone(level)  # no partition hears of these; keys below 0 are no partition's
        rows.append(_row(-1 - key, SUMS, key, None, _sums(level.train[own])))
        return _table(rows)

    return each


def _scorer(model: Model, fan: int, names: list[str], id_type: pa.DataType):
    def each(table: pa.Table) -> pa.Table:
        block = _block_of(table, model.order, model, fan, True)
        starts = np.cumsum(block.lens) - block.lens
        add = lambda x: np.add.reduceat(x, starts)
        top, counts = block.levels[-1], block.levels[0].count[block.tokens]
        each_token = np.log10(top.p)[top.of[block.inside]]
        ids = table.filter(pc.equal(table["kind"], BODY))["ids"][0].as_py()
        columns = [pa.array(block.rows), pa.array(block.parts), pa.array(ids, id_type), pa.array(block.held), pa.array(block.lens), pa.array(add((counts > 0).astype(np.int64))), pa.array(add(model.words.base(counts))), pa.array(add(each_token))]
        return pa.table(columns, names=names)

    return each


def _free(df: DataFrame) -> None:
    """Lets the driver drop shuffle files of plans that are done (they go when their handles do)."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1, order: int = ORDER, block: int = BLOCK, partition_tokens: int = PARTITION, fan: int = FAN) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, discounting.

    Rows whose crc32(doc_id as text) mod `folds` is `fold` are held out, the others train the model.
    """
    if order < 1 or fan < 2 or block < order:
        raise ValueError("order is at least 1, fan at least 2, a block holds order tokens at least")
    scratch = Scratch(docs.sparkSession)
    held = F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds == fold, F.lit(False))
    rows = docs.select(F.col(id_col).alias("__id"), held.alias("__held"), F.col(text_col).alias("__text"))
    own = scratch.table(blocks(rows, order, block, fan), "blocks", ["kind"])
    tokens, opens, many = own.where(f"kind = {BODY}").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("opens"), F.lit(0)), F.count(F.lit(1))).first()
    levels = _levels(tokens, partition_tokens, fan)
    model = Model(order, 0, opens, many, min(max(1024, levels[-1]), 1 << 16))

    sums = lambda df: [float(x) for x in df.where("stats is not null").where(f"kind <> {CONTEXT}").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0.0)) for i in range(K + 3)]).first()]
    asked = own.where(f"kind = {WORDS}").select("key", "data").mapInArrow(_ask_words(fan), _ROWS)
    found = {1: _exchange(asked, 1, many, levels, model, scratch, "words", fan)}
    scratch.drop(f"blocks/kind={WORDS}")
    told = sums(found[1])
    model.words, model.total = Words(int(told[0]), int(told[1]), np.array([0, *told[2:]], float)), int(told[0])

    body = own.where(f"kind = {BODY}").select("key", F.lit(0).alias("n"), F.lit(BODY).alias("kind"), F.lit(0).cast("long").alias("source"), "data", "ids")
    no_ids = F.lit(None).cast(body.schema["ids"].dataType).alias("ids")

    def with_answers(*columns: str) -> DataFrame:
        out = body
        for n, df in found.items():
            kinds = (ANSWER, LOST) if "ids" in columns else (ANSWER,)  # ids: for scoring
            out = out.unionByName(df.where(F.col("kind").isin(*kinds)).select("key", F.lit(n).alias("n"), "kind", "source", "data", no_ids))
        return out.select(*columns).repartition(max(1, many), "key").groupBy("key")

    names = [model.words.name]
    for n in range(2, order + 1):
        asked = with_answers("key", "n", "kind", "source", "data").applyInArrow(_asker(n, model, fan), _ROWS)
        found[n] = _exchange(asked, n, many, levels, model, scratch, f"grams{n}", fan)
        told = sums(found[n])
        model.d[n], name = discounts(np.array([0, *told[2:]], float))
        names.append(name)
        hot = found[n].where(f"kind = {CONTEXT}").groupBy("key").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(K + 2)]).collect()  # `share` rows at most
        ids = np.array([r[0] for r in hot], np.int64).view(np.uint64)
        at = np.argsort(ids)
        model.hot[n] = ids[at], np.array([list(r[1:]) for r in hot], float).reshape(-1, K + 2)[at]
        _free(docs)

    id_field = T.StructField("doc_id", rows.schema["__id"].dataType)
    kinds = [T.StructField(n, k) for n, k in (("__row", T.LongType()), ("__part", T.BooleanType()))] + [id_field, T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    scorer = _scorer(model, fan, [k.name for k in kinds], to_arrow_type(id_field.dataType))
    scored = scratch.table(with_answers(*body.columns).applyInArrow(scorer, T.StructType(kinds)), "scores")
    split = scored.where("__part").groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    out = scored.where("not __part").drop("__part").unionByName(split).withColumns({"train_tokens": F.lit(model.total).cast("long"), "discounting": F.lit(",".join(names))})
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "discounting")

