import pytest
from pyspark.sql import functions as F

import tallygrove.operators.skew as skew
from tallygrove.operators.skew import held_bytes, hot_keys, is_small, join_salted, keep_rows


@pytest.fixture
def left(spark):
    """A third of the rows under one key, which half of the others repeat now and then."""
    return spark.range(3000).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 900).cast("string")))
        .alias("key"),
    )


@pytest.fixture
def right(spark):
    keys = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    return keys.unionByName(spark.createDataFrame([("hot",)], "key string")).withColumn(
        "value", F.length("key")
    )


@pytest.fixture
def low_limits(monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 100)


def test_few_rows_are_never_hot(left):
    assert hot_keys(left, "key").count() == 0


def test_hot_keys(left, low_limits):
    assert [tuple(r) for r in hot_keys(left, "key").collect()] == [("hot", 10)]


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
@pytest.mark.parametrize("task_rows, small_rows", [(100, 200_000), (1, 0), (1_000_000, 200_000)])
def test_salted_join_is_exact(monkeypatch, left, right, how, task_rows, small_rows):
    monkeypatch.setattr(skew, "TASK_ROWS", task_rows)
    monkeypatch.setattr(skew, "SMALL_ROWS", small_rows)
    some = right.where("key <> 'k7' and key not like 'k1%'")
    plain = sorted(map(tuple, left.join(some, "key", how).collect()))
    salted = join_salted(left, some, "key", "row", how)
    found = salted.select(*left.join(some, "key", how).columns).collect()
    assert sorted(map(tuple, found)) == plain


def test_hot_rows_are_spread(spark, left, right, low_limits):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = join_salted(left, right, "key", "row", "inner")
        parts = joined.where("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 600


@pytest.mark.parametrize("share", [0.1, 0.9])
def test_keep_rows_by_either_side(left, share):
    keys = left.where(F.col("row") < int(3000 * share)).select("row")
    kept = keep_rows(left, keys, ["row"])
    assert sorted(r["row"] for r in kept.collect()) == list(range(int(3000 * share)))
    kind = "LeftSemi" if share < 0.5 else "LeftAnti"
    assert kind in kept._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kept", [["(null,1)"], ["(null,1)", "(p,1)", "(q,1)"], ["(p,1)"], []])
def test_a_null_is_a_key_like_any_other(spark, kept):
    data = [(None, 1), ("p", 1), ("q", 1), ("r", None)]
    rows = spark.createDataFrame([(*key, "text") for key in data], "path string, seq int, content string")
    chosen = [key for key in data if f"({key[0] or 'null'},{key[1]})" in kept]
    keys = spark.createDataFrame(chosen, "path string, seq int")
    found = keep_rows(rows, keys, ["path", "seq"]).collect()
    assert sorted((r["path"], r["seq"]) for r in found if r["path"]) == sorted(k for k in chosen if k[0])
    assert len(found) == len(chosen)


def test_held_bytes(spark):
    rows = spark.createDataFrame([("x" * 1000, ["y"] * 1000)] * 50, "key string, list array<string>")
    assert 50 * 4000 < held_bytes(rows) < 50 * 8000 and held_bytes(rows.limit(0)) == 0


def test_is_small(spark, monkeypatch):
    keys = spark.createDataFrame([("abc",), ("de",)], "key string")
    assert is_small(keys) and is_small(keys.limit(0))
    monkeypatch.setattr(skew, "SMALL_BYTES", 4)
    assert not is_small(keys)
    monkeypatch.setattr(skew, "SMALL_BYTES", 5)
    monkeypatch.setattr(skew, "SMALL_ROWS", 1)
    assert not is_small(keys)
