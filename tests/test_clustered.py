"""What the clustered store reads, and how its runs are merged."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import store as ops
from tallygrove.operators.measure import measure
from tallygrove.sinks import clustered
from tallygrove.sinks.clustered import ClusteredStore, bloom_filter, bloom_holds
from tallygrove.sinks.store import ResultStore
from tallygrove.streaming.incremental import start_incremental

STORED = "path string, content string, tokens bigint, mtime bigint, error string"


def rows(spark, paths, mtime=1):
    data = [(p, f"text of {p}", 3, mtime, None) for p in paths]
    return spark.createDataFrame(data, STORED)


def asked(spark, paths, mtime=1):
    return spark.createDataFrame([(k, p, mtime) for k, p in enumerate(paths)], "pos bigint, path string, mtime bigint")


def files(frame):
    """Files of buckets in the plan of a frame, as their directories."""
    return {"/".join(name.split("/")[-3:-1]) for name in frame.inputFiles() if "/bucket=" in name}


@pytest.mark.parametrize("n", [1, 3, 500, 20_000])
def test_bloom(n):
    draw = np.random.default_rng(n)
    held, others = (draw.integers(0, 1 << 63, n, np.uint64) for _ in range(2))
    bloom = bloom_filter(held)
    assert bloom_holds(bloom, held).all()
    assert n < 500 or bloom_holds(bloom, others).mean() < 0.02


def test_reads_touched_buckets_only(spark, tmp_path):
    store = ClusteredStore.create(spark, str(tmp_path / "s"), buckets=16)
    for seq in (1, 2, 3):
        store.append(rows(spark, [f"dir/{seq}/{k}" for k in range(200)]), seq=seq)
    wanted = asked(spark, ["dir/2/7", "nowhere/7"])
    places = store.touched(wanted, store._runs())
    bucket = rows(spark, ["dir/2/7"]).select(store._bucket()).first()[0]
    assert ((0, 2, 2), bucket) in places and len(places) <= 2  # others but for a chance of the filter
    keys = store._keys(places)
    assert files(keys) == {f"seq={run[1]}/bucket={b}" for run, b in places}
    assert "content" not in keys._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    met = store.met(wanted, before=4)
    assert {(r["path"], r["seq"]) for r in met.collect()} == {("dir/2/7", 2), ("nowhere/7", None)}
    hits = store.hits(met, before=4)
    assert files(hits) == {f"seq=2/bucket={bucket}"}
    assert [r["content"] for r in hits.collect()] == ["text of dir/2/7"]


def test_runs_are_merged(spark, tmp_path, monkeypatch):
    """After many writes a few runs hold all keys, and the answers are those of a plain log."""
    monkeypatch.setattr(clustered, "RUNS", 2)
    draw = random.Random(1)
    store = ClusteredStore.create(spark, str(tmp_path / "s"), buckets=4)
    plain = ResultStore.create(spark, str(tmp_path / "plain"))
    names = [None, *(f"p{k}" for k in range(30))]
    for seq in range(1, 8):
        some = rows(spark, draw.sample(names, 6), mtime=draw.randint(1, 9))
        for target in (store, plain):
            target.append(some, seq=seq)
    assert store._runs() == [(2, 1, 4), (1, 5, 6), (0, 7, 7)]
    assert store._runs(before=4) == [(1, 1, 2), (0, 3, 3)]
    for before in (4, 8):
        for exact in (False, True):
            wanted = asked(spark, names, mtime=5)
            found = [sorted(map(tuple, s.met(wanted, before, exact).drop("pos").collect()), key=str) for s in (store, plain)]
            assert found[0] == found[1]
            found = [sorted(map(tuple, s.hits(s.met(wanted, before, exact), before).collect()), key=str) for s in (store, plain)]
            assert found[0] == found[1]
    # An earlier write done again: runs over it are made anew.
    for target in (store, plain):
        target.append(rows(spark, ["p1", "new"], mtime=50), seq=3)
    wanted = asked(spark, [*names, "new"], mtime=1)
    found = [sorted(map(tuple, s.met(wanted, 8).drop("pos").collect()), key=str) for s in (store, plain)]
    assert found[0] == found[1]


def test_a_stream_reads_no_more_with_time(spark, tmp_path, monkeypatch):
    """Twenty batches of new paths, some old ones again: the keys read by a batch stay few."""
    store = ClusteredStore.create(spark, str(tmp_path / "s"), buckets=8)
    source = str(tmp_path / "in")
    version = "path string, content string, mtime bigint"
    for batch in range(20):
        data = [(f"b{batch}/{k}", "one two", 1) for k in range(40)] + [(f"b{max(batch - 1, 0)}/0", "three", batch)]
        spark.createDataFrame(data, version).coalesce(1).write.mode("append").parquet(f"{source}")
    read = []
    met = ops.met_versions

    def counted(requests, log, *rest):
        read.append(log.count())
        return met(requests, log, *rest)

    monkeypatch.setattr(ops, "met_versions", counted)
    stream = spark.readStream.schema(version).option("maxFilesPerTrigger", 1).parquet(source)
    start_incremental(stream, store, str(tmp_path / "c")).awaitTermination()
    assert len(read) == 20
    assert store.latest().count() == 800
    assert max(read[10:]) <= 130  # a plain log has 400 to 800 rows there


def test_rows_of_latest(spark, tmp_path):
    store = ClusteredStore.create(spark, str(tmp_path / "s"))
    store.append(measure(asked(spark, ["a", None]).withColumn("content", F.lit("x y"))))
    assert sorted(map(tuple, store.latest().collect()), key=str) == [("a", "x y", 2, 1, None, 1), (None, "x y", 2, 1, None, 1)]
    assert store.next_seq() == 2
