"""Role repair against all labellings."""

import itertools
import random
import re

import pytest

from marlstone.llm import chat

TURNS = "conv_id long, turn long, role string, text string, seq string, cost string"
ORDER = ["system", "user", "assistant"]


def cost_of(roles, labels):
    """Cost of a labelling, or None; what lies between two turns is inserted."""
    total, last = 0, None
    for role, label in zip(roles, labels):
        total += 3 * (role != label)
        if label == last:
            total += 1
        elif label == "system" and last is not None:
            return None
        elif label == "assistant" and last in (None, "system"):
            total += 2
        last = label
    return total + {"assistant": 0, "user": 2, "system": 4}[last]


def cheapest(roles):
    return min(c for labels in itertools.product(ORDER, repeat=len(roles)) if (c := cost_of(roles, labels)) is not None)


def conversations(n):
    draw = random.Random(n)
    return {c: [draw.choice([*ORDER, "user", "assistant", "tool", None]) for _ in range(draw.randint(1, 7))] for c in range(n)}


@pytest.mark.parametrize("chunk", [1024, 2])
def test_cheapest_and_legal(spark, chunk):
    talks = conversations(60)
    rows = [(c, t * 3, r, f"c{c}t{t}" if t % 4 else None, "x", "y") for c, roles in talks.items() for t, r in enumerate(roles)]
    found = chat.repair(spark.createDataFrame(rows, TURNS).repartition(4), chunk=chunk).collect()
    assert len(found) == len(rows)
    for c, roles in talks.items():
        own = sorted((r for r in found if r.conv_id == c), key=lambda r: r.seq)
        assert [r.turn for r in own] == [3 * t for t in range(len(roles))]
        assert sum(r.cost for r in own) == cheapest(roles) == cost_of(roles, [r.role for r in own])
        text = "".join(r.rendered for r in own)
        turns = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
        assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in turns) == text
        assert re.fullmatch("(system,)?(user,assistant,)+", "".join(f"{a}," for a, _ in turns))
        assert re.findall(r"c\d+t\d+", text) == [f"c{c}t{t}" for t in range(len(roles)) if t % 4]


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, None, None, None, None), (None, 1, "user", "a", None, None), (7, 0, "user", "b", None, None), (7, 0, "user", "b", None, None), (7, 1, "assistant", "c", None, None)]
    df = spark.createDataFrame(rows, TURNS)
    found = chat.repair(df).collect()
    assert "".join(r.rendered for r in sorted((r for r in found if r.conv_id == 7), key=lambda r: r.seq)) == "<|im_start|>user\nb\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert sorted((r.turn is None, r.role, r.action) for r in found if r.conv_id is None) == [(False, "user", "keep"), (True, "assistant", "relabel")]
    assert chat.repair(df.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = [(1, t, ["user", "assistant"][t % 2] if t % 5 else "user", "x", None, None) for t in range(3000)]
    found = chat.repair(spark.createDataFrame(rows, TURNS), chunk=128).collect()
    whole = chat.repair(spark.createDataFrame(rows, TURNS), chunk=4096).collect()
    assert sum(r.cost for r in found) == sum(r.cost for r in whole) > 0
