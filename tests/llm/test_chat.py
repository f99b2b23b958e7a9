"""Roles of transcript lines: the likeliest path against all paths, and held-out accuracy."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import chat
from tallygrove.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block int, `x.y` int"
MANUAL = [
    (1, 0, "user", "User: hello there?", 1, 2),
    (1, 1, "assistant", "Assistant: good day\nUser names are private.\n\nNote: a note", 1, 2),
    (1, 2, "user", "User: thanks", 1, 2),
    (2, 0, "system", "[system] be kind", 1, 2),
    (2, 1, "user", "**Q:** why?", 1, 2),
    (2, 2, "assistant", "**A:** because", 1, 2),
]


@pytest.mark.parametrize("seed", range(5))
def test_likeliest_path(seed):
    draw = np.random.default_rng(seed)

    def logs(*shape):
        return np.log(draw.dirichlet(np.ones(shape[-1]), shape[:-1]))

    model = chat.RoleModel(logs(chat.STATES), logs(chat.STATES, chat.STATES), [logs(chat.STATES, n) for n in chat.OBSERVED])
    observed = np.array([[draw.integers(n) for n in chat.OBSERVED] for _ in range(5)])

    def score(path):
        total = model.start[path[0]] + sum(model.move[a, b] for a, b in zip(path, path[1:]))
        return total + sum(t[s, o[k]] for s, o in zip(path, observed) for k, t in enumerate(model.seen))

    best = max(product(range(chat.STATES), repeat=5), key=score)
    assert tuple(chat.likeliest(observed, model)) == best
    assert chat.likeliest(observed[:0], model) == []


@pytest.mark.parametrize(
    "line, kind, rest",
    [
        ("User: hi", "user", "hi"), ("**Assistant:** ok", "assistant", "ok"), ("[SYSTEM] x", "system", "x"),
        ("<|user|> q", "user", "q"), ("### Human: q", "user", "q"), ("Q: q", "user", "q"), ("> quoted", "quote", "quoted"),
        ("A cat sat", "none", "A cat sat"), ("Userland: x", "other", "Userland: x"), ("", "none", ""), ("é: x", "other", "é: x"),
    ],
)
def test_markers(line, kind, rest):
    number, end = chat.marker(line)
    assert (chat.KINDS[number], line[end:]) == (kind, rest)


def test_parsed(spark):
    rows = spark.createDataFrame(MANUAL, SCHEMA).repartition(3)
    model = chat.fit(rows)
    found = chat.parse(rows.drop("role"), model)
    assert found.columns == ["conv_id", "block", "part", "n_lines", "roles", "text"]
    by_id = {r["conv_id"]: r for r in found.collect()}
    assert by_id[1]["roles"] == ["user", "assistant", "user"] and by_id[1]["n_lines"] == 6
    assert by_id[1]["text"] == (
        "<|user|>\nhello there?\n<|assistant|>\ngood day\nUser names are private.\n\nNote: a note\n<|user|>\nthanks\n"
    )
    assert by_id[2]["text"] == "<|system|>\nbe kind\n<|user|>\nwhy?\n<|assistant|>\nbecause\n"


def test_odd_rows(spark, monkeypatch):
    rows = [*MANUAL, MANUAL[0], MANUAL[0], (1, None, None, None, 1, 2), (None, 3, "user", "", 1, 2), (None, None, "bot", "x", 1, 2)]
    rows += [(3, n, "user", f"User: line {n}", 1, 2) for n in range(30)] + [(4, 0, "assistant", "word " * 200_000, 1, 2)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = chat.fit(table)
    found = chat.parse(table, model).collect()
    lines = {(r["conv_id"], r["block"], r["part"]): r["n_lines"] for r in found}
    assert lines == {(1, 0, 0): 9, (2, 0, 0): 3, (3, 0, 0): 30, (4, 0, 0): 1, (None, 0, 0): 2}
    monkeypatch.setattr(chat, "BLOCK_TURNS", 10)
    monkeypatch.setattr(chat, "PART_BYTES", 50)
    parts = [r for r in chat.parse(table, model).collect() if r["conv_id"] == 3]
    assert {r["block"] for r in parts} == {0, 1, 2} and sum(r["n_lines"] for r in parts) == 30 and len(parts) > 3
    empty = table.limit(0)
    assert chat.parse(empty, chat.fit(empty)).collect() == []


def test_cuts_change_nothing(spark, monkeypatch):
    """Roles and transcripts of a conversation in parts are those of the uncut one; so is the model."""
    draw = np.random.default_rng(4)
    rows, roles = [], ["user", "assistant"]
    for n in range(120):
        role = roles[n % 2]
        mark = "User: " if role == "user" else draw.choice(["", "", "Assistant: "])
        lines = [draw.choice(["some words", "  ", "", "why?", "a longer line " * 9]) for _ in range(draw.integers(1, 5))]
        rows.append((5, n, role, mark + "\n".join(lines), 1, 2))
    rows += MANUAL
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = chat.fit(table)
    raw = table.drop("role")
    whole = {r["conv_id"]: r for r in chat.parse(raw, model).collect()}
    assert len(whole) == 3
    for turns, size in ((7, 8 << 20), (4096, 60), (3, 1)):
        monkeypatch.setattr(chat, "BLOCK_TURNS", turns)
        monkeypatch.setattr(chat, "PART_BYTES", size)
        cut = chat.fit(table)
        for a, b in zip((model.start, model.move, *model.seen), (cut.start, cut.move, *cut.seen), strict=True):
            assert np.array_equal(a, b)
        found = sorted(chat.parse(raw, model).collect(), key=lambda r: (r["conv_id"], r["block"], r["part"]))
        assert len(found) > 10
        for conversation, one in whole.items():
            parts = [r for r in found if r["conv_id"] == conversation]
            assert [x for r in parts for x in r["roles"]] == one["roles"]
            assert "".join(r["text"] for r in parts) == one["text"]
            assert sum(r["n_lines"] for r in parts) == one["n_lines"]


def test_held_out_conversations(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op6_chat_formatting"](spark, sf)
    turns = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]).alias("true")
    )
    rows = found.join(turns, "conv_id").where("held_out").select((F.col("roles") == F.col("true")).alias("right")).collect()
    assert sum(r["right"] for r in rows) >= 0.9 * len(rows) > 0
