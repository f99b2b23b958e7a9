"""Ranked search against scores of all documents for all items."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tallygrove.llm import lexical, oracles, queries
from tests.conftest import SF

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(documents, items, best):
    counts = [(doc, Counter(terms(text))) for doc, text in documents]
    counts = [(doc, c) for doc, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scores = []
        for doc, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in own if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc))
        for rank, (score, _, doc) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:best], 1):
            out.append((item, rank, doc, -score))
    return out


def case(seed, n=300):
    draw = random.Random(seed)
    words = ["w%d" % k for k in range(60)] + ["É", "Straße", "7", "中"]
    weights = [1 / (k + 1) for k in range(len(words))]

    def text(most):
        return draw.choice([" ", "-", "_"]).join(draw.choices(words, weights, k=draw.randint(0, most)))

    documents = [(draw.choice([k, k, k % 7, None]), text(40)) for k in range(n)]
    documents += [(n, None), (n + 1, ""), (n + 2, "..."), (5, "W1 w2"), (5, "W1 w2"), (n + 3, "w1 " * 5000)]
    items = [(draw.choice([k, k, None, 3]), text(12)) for k in range(25)] + [(90, None), (91, "unknown"), (92, "")]
    return documents, items


@pytest.mark.parametrize("seed", range(6))
def test_equals_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(lexical, "SHARD_DOCS", [4096, 20, 33][seed % 3])
    documents, items = case(seed)
    docs = spark.createDataFrame([(*d, 1) for d in documents], "doc_id bigint, text string, score int").repartition(3)
    wanted = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, rank string")
    best, block = [10, 1, 3][seed % 3], [200_000, 15][seed % 2]
    found = [tuple(r) for r in lexical.search(docs, wanted, best=best, item_terms=block).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(found, key=order) == sorted(expected(documents, items, best), key=order)


def test_prunes():
    """Most pairs of a shard are never scored, and the best are found all the same."""
    draw = np.random.default_rng(3)
    rows = [np.unique(draw.zipf(1.3, 30) % 2000) for _ in range(4000)]
    values = [draw.integers(1, 900_000, len(r)) for r in rows]
    weights = np.linspace(1, 9000, 2000).astype(np.int64)
    items = [sorted(set(rows[k].tolist())) for k in range(0, 4000, 100)]
    tree = lexical.DualTree(items, weights)
    tree.search(list(range(4000)), np.append(0, np.cumsum([len(r) for r in rows])), np.concatenate(rows), np.concatenate(values))
    for item, own in enumerate(items):
        scores = [int(sum(weights[t] * v for t, v in zip(r, x) if t in set(own))) for r, x in zip(rows, values)]
        best = sorted((-s, k) for k, s in enumerate(scores) if s > 0)[:10]
        assert best == [(-int(s), int(k)) for s, k in zip(tree.found[item][0], tree.found[item][2])]
    assert tree.scored < 0.3 * len(items) * 4000


def test_empty_tables(spark):
    docs, items = "doc_id bigint, text string", "item_id string, text string"
    none = spark.createDataFrame([], docs), spark.createDataFrame([], items)
    some = spark.createDataFrame([(1, "a")], docs), spark.createDataFrame([("x", "a")], items)
    for d, i in [(none[0], none[1]), (some[0], none[1]), (none[0], some[1])]:
        assert lexical.search(d, i).collect() == []
    assert [tuple(r)[:3] for r in lexical.search(*some).collect()] == [("x", 1, 1)]


def test_query_equals_sql(spark):
    found = queries.QUERIES["op13_lexical_search"](spark, SF)
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    expected = connection.sql(oracles.OP13).project("item_id, rank, doc_id, score").fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
