"""Chat formatting with minimum-cost role repair.

Legal conversations: a system turn or none, then user and assistant in turn, an assistant last. A row may
keep its role or be relabelled (cost 3); a row whose role is the last turn's is merged into that turn (1);
where a turn is missing, an empty one is inserted (2). Dynamic programming over the automaton of last roles
finds the cheapest repair; of equal ones it takes that whose states come first (start, system, user,
assistant), looked at from the end. The repaired sequence is rendered as one fragment per row; a
conversation's text is its fragments in the order of `seq`, so no conversation has to fit one string.

Rows of a conversation are ordered by (turn, null last; then a hash of role and text). Conversations of up to
`chunk` turns are sorted into whole conversations by one shuffle and repaired in one pass over Arrow batches.
Longer ones are found by a count first; they are ranked by ranges and cut into chunks: each gives the matrix of
its cheapest costs between states, matrices are multiplied (least sums) in groups of `chunk` until a
conversation has no more than that, chained, and each chunk is then traced between its known states. So of equally
cheap repairs of a long conversation the states at the ends of chunks come first. No task holds a long one.

Control strings. A text that holds `<|im_start|>` or `<|im_end|>` could forge turns; such strings are rendered
with a backslash before the first bar.

Edge cases. Null or unknown role: has to be relabelled. Null text: an empty turn. Very long texts move once, as
they are; a turn's text is one string. Null conv_id: one conversation of its own. Null turns come last.
Repeated rows: each is a turn (and so merged). A conversation with a system turn alone gets an empty user and
assistant turn. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, group_key, parts_for, ranked

ROLES = ("system", "user", "assistant")
MERGE, INSERT, RELABEL = 1, 2, 3
CHUNK = 1024
_NO = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
#: Cost of a turn of role (column) after a state (row), with what has to be inserted before it.
_STEP = np.array([[_NO, 0, 0, INSERT], [_NO, MERGE, 0, INSERT], [_NO, _NO, MERGE, 0], [_NO, _NO, 0, MERGE]], np.int64)
_END = np.array([_NO, 2 * INSERT, INSERT, 0], np.int64)
#: By the row's role (0: none of ROLES): cost from state to state.
_COST = np.stack([_STEP + np.array([0] + [RELABEL * (role != t) for t in (1, 2, 3)]) for role in range(4)])


def trace(roles: np.ndarray, first: np.ndarray, entry: np.ndarray, leave: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """States after each row, and cost, of many stretches at once.

    roles: role codes of all stretches on end; first: where each begins; entry: state before it; leave: state
    after it, or None where it ends the conversation (then the end's insertions count).
    """
    sizes = np.diff(np.append(first, len(roles)))
    cost = np.full((len(first), 4), _NO, np.int64)
    cost[np.arange(len(first)), entry] = 0
    back, by_size = np.zeros((len(roles), 4), np.int8), np.argsort(-sizes, kind="stable")
    for i in range(int(sizes.max(initial=0))):
        on = by_size[: np.searchsorted(-sizes[by_size], -i, side="left")]
        ways = cost[on][:, :, None] + _COST[roles[first[on] + i]]
        back[first[on] + i] = ways.argmin(axis=1)
        cost[on] = np.minimum(ways.min(axis=1), _NO)
    last = (cost + _END).argmin(axis=1) if leave is None else leave
    total = cost[np.arange(len(first)), last] + (_END[last] if leave is None else 0)
    states, at = np.zeros(len(roles), np.int8), last.copy()
    for i in range(int(sizes.max(initial=0)) - 1, -1, -1):
        on = by_size[: np.searchsorted(-sizes[by_size], -i, side="left")]
        states[first[on] + i] = at[on]
        at[on] = back[first[on] + i, at[on]]
    return states, total


def matrices(roles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Cheapest costs from state to state over each stretch."""
    sizes = np.diff(np.append(first, len(roles)))
    cost = np.where(np.eye(4, dtype=bool), 0, _NO)[None].repeat(len(first), axis=0)
    for i in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > i)
        cost[on] = np.minimum((cost[on][:, :, :, None] + _COST[roles[first[on] + i]][:, None]).min(axis=2), _NO)
    return cost


def chain(costs: np.ndarray, entry: int = START, leave: int | None = None) -> list[int]:
    """States before the first and after each of consecutive chunks; leave: the last one (None: the cheapest end)."""
    best, back = np.full(4, _NO), []
    best[entry] = 0
    for m in costs:
        ways = best[:, None] + m
        back.append(ways.argmin(axis=0))
        best = np.minimum(ways.min(axis=0), _NO)
    states = [int((best + _END).argmin()) if leave is None else leave]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _codes(roles: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.add(pc.index_in(roles, value_set=pa.array(ROLES)), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _sorted(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows by (__key, __chunk, __pos), their role codes, and where each stretch begins."""
    table = table.sort_by([("__key", "ascending"), ("__chunk", "ascending"), ("__pos", "ascending")])
    same = [table[c].to_pylist() for c in ("__key", "__chunk")]
    first = [i for i, x in enumerate(zip(*same)) if not i or x != (same[0][i - 1], same[1][i - 1])]
    return table, _codes(table["__role"]), np.array(first, np.int64)


_OUT = "__key string, __pos long, __before byte, __state byte"


def _decided(table: pa.Table, first: np.ndarray, entry: np.ndarray, states: np.ndarray) -> pa.Table:
    before = np.concatenate([[0], states[:-1]]).astype(np.int8) if len(states) else states
    before[first] = entry
    return pa.table({"__key": table["__key"], "__pos": table["__pos"], "__before": pa.array(before), "__state": pa.array(states)})


def _before(states: np.ndarray, first: np.ndarray, entry: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], states[:-1]]).astype(np.int8) if len(states) else states
    before[first] = entry
    return before


def _starts(ids: pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal ids begin; null equals null."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    if not len(ids):
        return np.zeros(0, np.int64)
    a, b = ids.slice(0, len(ids) - 1), ids.slice(1)
    apart = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[0], np.flatnonzero(apart.to_numpy(zero_copy_only=False)) + 1]).astype(np.int64)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by conversation -> the same rows with __pos, __n, __before and __state. What a batch leaves open
    of its last conversation waits for the next."""

    def decided(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes, entry = np.diff(np.append(first, len(table))), np.zeros(len(first), np.int64)
        states, _ = trace(_codes(table["__role"]), first, entry, None)
        more = (np.arange(len(table)) - np.repeat(first, sizes), np.repeat(sizes, sizes), _before(states, first, entry), states)
        for name, values in zip(("__pos", "__n", "__before", "__state"), more):
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches()

    held = None
    for b in batches:
        table = pa.Table.from_batches([b])
        held = table if held is None else pa.concat_tables([held, table])
        first = _starts(held["conv_id"])
        if len(first) > 1:
            yield from decided(held.slice(0, int(first[-1])), first[:-1])
            held = held.slice(int(first[-1]))
    if held is not None and len(held):
        yield from decided(held, _starts(held["conv_id"]))


def _decided(table: pa.Table, first: np.ndarray, entry: np.ndarray, states: np.ndarray) -> pa.Table:
    return pa.table({"__key": table["__key"], "__pos": table["__pos"], "__before": pa.array(_before(states, first, entry)), "__state": pa.array(states)})


def _matrix(table: pa.Table) -> pa.Table:
    table, roles, first = _sorted(table)
    return pa.table({"__key": table["__key"].take(first), "__chunk": table["__chunk"].take(first), "__m": pa.array(list(matrices(roles, first).reshape(-1, 16)), pa.list_(pa.int64()))})


_MATRIX, _ENDS = "__key string, __chunk long, __m array<long>", "__key string, __chunk long, __in long, __out long"


def _product(table: pa.Table) -> pa.Table:
    """One group of consecutive matrices -> that of all its rows."""
    table = table.sort_by("__chunk")
    total = np.where(np.eye(4, dtype=bool), 0, _NO)
    for m in np.array(table["__m"].to_pylist(), np.int64).reshape(-1, 4, 4):
        total = np.minimum((total[:, :, None] + m[None]).min(axis=1), _NO)
    return pa.table({"__key": table["__key"].slice(0, 1), "__chunk": table["__outer"].slice(0, 1), "__m": pa.array([total.ravel()], pa.list_(pa.int64()))})


def _chained(table: pa.Table) -> pa.Table:
    """One group of consecutive matrices, with the states around it if there are other groups."""
    table = table.sort_by("__chunk")
    ends = (table["__in"][0].as_py(), table["__out"][0].as_py()) if "__in" in table.column_names else ()
    s = chain(np.array(table["__m"].to_pylist(), np.int64).reshape(-1, 4, 4), *ends)
    return pa.table({"__key": table["__key"], "__chunk": table["__chunk"], "__in": pa.array(s[:-1], pa.int64()), "__out": pa.array(s[1:], pa.int64())})


def _ends(costs: DataFrame, most: int, group: int, scratch: Scratch) -> DataFrame:
    """costs(__key, __chunk, __m) -> the states around each chunk. most: chunks of the longest conversation."""
    if most <= group:
        return costs.groupBy("__key").applyInArrow(lambda t: _chained(t), _ENDS)
    costs = costs.withColumn("__outer", F.expr(f"__chunk div {group}"))
    outer = scratch.table(costs.groupBy("__key", "__outer").applyInArrow(lambda t: _product(t), _MATRIX), f"products{most}")
    ends = _ends(outer, -(-most // group), group, scratch).withColumnRenamed("__chunk", "__outer")
    return costs.join(ends, ["__key", "__outer"]).groupBy("__key", "__outer").applyInArrow(lambda t: _chained(t), _ENDS)


def _between(table: pa.Table) -> pa.Table:
    table, roles, first = _sorted(table)
    entry, leave = (table[c].to_numpy()[first] for c in ("__in", "__out"))
    return _decided(table, first, entry, trace(roles, first, entry, leave)[0])


def _long(rows: DataFrame, order: list[Column], turns: int, most: int, chunk: int, scratch: Scratch) -> DataFrame:
    """rows of conversations of more than `chunk` turns, with __pos, __n, __before and __state."""
    placed = ranked(rows.withColumn("__key", group_key(F.col("conv_id"))), ["__key"], order, "__pos", "__n", scratch, "long_turns")
    slim = placed.select("__key", "__pos", "__role", F.expr(f"__pos div {chunk}").alias("__chunk"))
    deal = lambda df: df.withColumn("__part", F.pmod(F.xxhash64("__key", "__chunk"), F.lit(parts_for(turns, 20_000)))).groupBy("__part")
    costs = scratch.table(deal(slim).applyInArrow(lambda t: _matrix(t), _MATRIX), "matrices")
    ends = _ends(costs, -(-most // chunk), max(2, chunk), scratch)
    traced = deal(slim.join(ends, ["__key", "__chunk"])).applyInArrow(lambda t: _between(t), _OUT)
    return placed.join(traced, ["__key", "__pos"]).drop("__key")


def _turn(role: Column | str, text: Column | None = None) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.lit(role) if isinstance(role, str) else role, F.lit("\n"), F.lit("") if text is None else text)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per row: conv_id, turn, seq, role (repaired), action (keep, relabel, merge, relabel+merge), inserted (empty turns
    beside it), cost, rendered."""
    scratch = Scratch(turns.sparkSession)
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"<\|(im_start|im_end)\|>", r"<\\|$1|>")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("__role"), text.alias("__text"))
    order = [F.coalesce(F.col("turn").try_cast("long"), F.lit((1 << 63) - 1)), F.xxhash64("__role", "__text"), F.col("__role"), F.col("__text")]
    long = scratch.table(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("__many")).where(f"__many > {chunk}"), "long")
    turns_in_long, most = long.agg(F.coalesce(F.sum("__many"), F.lit(0)), F.coalesce(F.max("__many"), F.lit(0))).first()
    is_long = rows["conv_id"].eqNullSafe(long["conv_id"])
    short = rows.join(long, is_long, "left_anti") if most else rows
    kinds = [("__pos", T.LongType()), ("__n", T.LongType()), ("__before", T.ByteType()), ("__state", T.ByteType())]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(*k) for k in kinds]])
    done = short.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(_whole, schema)
    if most:
        done = done.unionByName(_long(rows.join(long, is_long, "left_semi"), order, turns_in_long, most, chunk, scratch))
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("__state").cast("int"))
    merged, relabelled = F.col("__before") == F.col("__state"), ~F.coalesce(F.col("__role") == role, F.lit(False))
    missing = (F.col("__state") == ASSISTANT) & F.col("__before").isin(START, SYSTEM)
    last = F.col("__pos") == F.col("__n") - 1
    after = F.when(last, 3 - F.greatest(F.col("__state").cast("int"), F.lit(1))).otherwise(0)
    close = "<|im_end|>\n"
    opened = F.concat(F.when(F.col("__pos") > 0, close).otherwise(""), F.when(missing, F.concat(_turn("user"), F.lit(close))).otherwise(""), _turn(role, F.col("__text")))
    tail = F.when(last, F.concat(F.lit(close), *[F.when(after >= k, F.concat(_turn(r), F.lit(close))).otherwise("") for k, r in ((2, "user"), (1, "assistant"))])).otherwise("")
    action = F.when(relabelled & merged, "relabel+merge").when(relabelled, "relabel").when(merged, "merge").otherwise("keep")
    inserted = missing.cast("int") + after
    return done.select(
        "conv_id", "turn", F.col("__pos").alias("seq"), role.alias("role"), action.alias("action"), inserted.cast("int").alias("inserted"),
        (merged.cast("int") * MERGE + relabelled.cast("int") * RELABEL + inserted * INSERT).cast("int").alias("cost"),
        F.concat(F.when(merged, F.concat(F.lit("\n"), F.col("__text"))).otherwise(opened), tail).alias("rendered"),
    )


def conversations(repaired: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Per conversation: conv_id, turns, n_bytes and text, its fragments in order (null above `most` bytes: such a
    conversation stays in fragments, so that none has to fit one task)."""
    sizes = repaired.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.octet_length("rendered")).cast("long").alias("n_bytes"))
    fits = sizes.where(F.col("n_bytes") <= most).select(F.col("conv_id").alias("__id"))
    own = repaired.join(fits, F.col("conv_id").eqNullSafe(F.col("__id")), "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("seq", "rendered")))
    text = own.groupBy(F.col("conv_id").alias("__id")).agg(F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("text"))
    return sizes.join(text, F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
