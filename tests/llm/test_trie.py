"""The trie against dictionaries of all prefixes."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import oracles, queries, trie
from tests.conftest import SF

SCHEMA = "conv_id bigint, turn int, role string, text string, depth string"


def sequences(rows):
    held = {}
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            pair = (role or "", text or "")
            digest = hashlib.sha256(f"{len(pair[0].encode())}:{pair[0]}{pair[1]}".encode()).hexdigest()
            held.setdefault(conv, []).append((turn is not None, turn or 0, digest[: 2 * trie.WIDTH], pair))
    return {conv: [t[3] for t in sorted(turns)] for conv, turns in held.items()}


def regrown(held, group=100, most=6):
    out = {}
    for conv, turns in held.items():
        taken = zlib.crc32(str(conv).encode()) % most
        out[conv] = held.get(conv - int(np.fmod(conv, group)), [])[:taken] + turns[taken:]
    return out


def expected(held):
    nodes = {}
    for conv, turns in held.items():
        for depth in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:depth]), []).append(conv)
    children, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for node in nodes:
        if node:
            children[node[:-1]] += 1
    for node, members in nodes.items():
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += not children[node]
            saved[node[:depth]] += (len(members) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(held[c]) == len(node))
        parent = min(nodes[node[:-1]]) if node else None
        out.append((min(members), len(node), parent, len(members), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=120):
    draw = random.Random(seed)
    texts = ["", "a", "é中", "hello there", "b" * 50]
    rows, copy = [], [(k, "user", texts[k % 5]) for k in range(5)]
    for conv in range(-150, -150 + n * 4, 4):
        kind = draw.random()
        turns = copy if kind < 0.35 else [(k, draw.choice(["user", "bot"]), draw.choice(texts)) for k in range(draw.randint(1, 7))]
        rows += [(conv, *t, "x") for t in turns]
    rows += [(100, k, "user", f"long {k // 3}", "x") for k in range(300)] + [(200, k, "user", f"long {k // 3}", "x") for k in range(299)]
    rows += [(5, None, None, None, None), (5, 0, "user", "a", None), (5, 0, "user", "a", None), (5, 0, "", "b", None)]
    rows += [(None, 0, "user", "lost", None), (None, None, None, None, None)]
    return draw.sample(rows, len(rows))


@pytest.mark.parametrize("seed", range(6))
def test_equals_dictionaries(spark, monkeypatch, seed):
    monkeypatch.setattr(trie, "SHARD_TURNS", [1 << 17, 1, 40, 400][seed % 4])
    rows = conversations(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    held = sequences(rows)
    own = trie.digested(frame)
    assert sorted(map(tuple, trie.prefix_trie(own).collect()), key=str) == expected(held)
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    found = trie.prefix_trie(trie.regrown(own, 100, 5, taken))
    assert sorted(map(tuple, found.collect()), key=str) == expected(regrown(held))


@pytest.mark.parametrize("size", [1, 2, 31, 32, 33, 64, 1000, 5000])
def test_findclose(size):
    draw = np.random.default_rng(size)
    for bias in (0.5, 0.95):
        opens, depth, left = [], 0, size
        while left or depth:
            go = left and (not depth or draw.random() < bias)
            opens.append(int(bool(go)))
            depth, left = depth + (1 if go else -1), left - bool(go)
        stack, close = [], {}
        for at, mark in enumerate(opens):
            if mark:
                stack.append(at)
            else:
                close[stack.pop()] = at
        places = np.flatnonzero(opens)
        found = trie.Parentheses(np.array(opens)).findclose(places)
        assert found.tolist() == [close[k] for k in places.tolist()]


def test_no_rows(spark):
    assert trie.prefix_trie(trie.digested(spark.createDataFrame([], SCHEMA))).collect() == []
    lost = spark.createDataFrame([(None, 1, "user", "x", "y")], SCHEMA)
    assert trie.prefix_trie(trie.digested(lost)).collect() == []


def test_query_equals_sql(spark):
    found = queries.QUERIES["op11_prefix_trie"](spark, SF)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    expected = connection.sql(oracles.OP11)
    assert sorted(map(tuple, found.select(*expected.columns).collect()), key=str) == sorted(expected.fetchall(), key=str)
