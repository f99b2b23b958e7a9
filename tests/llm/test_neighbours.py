"""Nearest neighbours against all cosines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import neighbours
from tallygrove.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, dim int, `query.x` int"


def expected(rows, k):
    """(query, rank, id, score) by all pairs, for the rows that take part."""
    usable = []
    for number, vector in rows:
        if number is None or not vector or any(x is None or not math.isfinite(x) for x in vector) or not any(vector):
            continue
        usable.append((number, np.array(vector, np.float32).astype(float)))
    out = set()
    for query in {i for i, _ in usable if i % 50 == 0}:
        best = {}
        for own in [v for i, v in usable if i == query]:
            for i, v in usable:
                if i != query and len(v) == len(own):
                    score = (v * own).sum() / math.sqrt((own * own).sum()) / math.sqrt((v * v).sum())
                    best[i] = max(score, best.get(i, -2))
        top = sorted(best.items(), key=lambda x: (-round(x[1], 11), x[0]))[:k]
        out |= {(query, rank, i, round(score, 9)) for rank, (i, score) in enumerate(top, 1)}
    return out


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA).repartition(5)
    result = neighbours.nearest(table, F.col("vec_id") % 50 == 0, **options)
    assert result.columns == ["query_id", "rank", "vec_id", "score"]
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in result.collect()}


def random_rows(seed, n=1500, dim=8):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(20, dim))
    rows = [(i, (centres[draw.integers(20)] + 0.3 * draw.normal(size=dim)).tolist()) for i in range(n)]
    copy = rows[3][1]
    return [(i, copy if i % 3 == 0 else v) for i, v in rows]  # a third are copies


@pytest.mark.parametrize("shard_rows", [10**6, 300])
def test_exact(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(neighbours, "LEAF", 16)
    rows = random_rows(1)
    assert found(spark, rows, shard_rows=shard_rows) == expected(rows, 5)


def test_ties_repeats_and_unusable_rows(spark):
    unit = [[1.0 if k == j else 0.0 for k in range(4)] for j in range(4)]
    rows = [(i, unit[i % 4]) for i in range(120)]
    rows += [(50, unit[0]), (50, unit[0]), (7, unit[1]), (100, unit[3])]  # repeated, and two vectors of one id
    rows += [(150, None), (200, []), (250, [0.0] * 4), (300, [1.0, None, 0.0, 0.0]), (350, [float("nan")] * 4)]
    rows += [(400, [float("inf")] * 4), (450, [1.0, 2.0]), (500, [2.0, 4.1]), (None, unit[0]), (550, [3.0])]
    assert found(spark, rows) == expected(rows, 5)


def test_few_candidates_and_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    assert found(spark, rows) == expected(rows, 5) and len(found(spark, rows)) == 2
    assert found(spark, [(0, [1.0])]) == set()
    assert found(spark, []) == set()


def test_a_larger_factor_finds_most(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 16)
    rows = random_rows(4)
    exact, loose = expected(rows, 5), found(spark, rows, factor=1.5)
    assert len(exact & loose) >= 0.9 * len(exact)


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in QUERIES["op9_neighbours"](spark, sf).collect()}
    assert got == expected(rows, 5)
