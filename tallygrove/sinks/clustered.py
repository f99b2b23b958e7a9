"""A result store whose lookups read only what may hold an answer.

Rows are written in hash buckets of their paths, in order of path, a directory `seq=N/bucket=B` each.
A run is a set of keys (path, mtime, seq), bucket by bucket: that of one write is the key columns of
its rows, contents are other column chunks of these files. Four runs of one level are merged to a
run of the next, which holds a path once, and only keys are written for it. So a path's versions lie
in a few runs, however many writes there were.

For every bucket of a run an index row holds the bounds of its paths and a Bloom filter of them. A
lookup of few paths looks through the index first, reads the key files of the buckets that may hold
one of them, and of the contents the buckets that do.

A run counts once its index is written, which is one file. Merged runs stay, so that whoever reads
them goes on; a run is passed by where a later one covers its writes. Repeated attempts replace what
they wrote. The same rows in, the same answers out, as with `ResultStore`.
"""

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.operators import store as ops
from tallygrove.operators.skew import keep_rows
from tallygrove.schemas import STORED
from tallygrove.sinks.store import _WRITTEN, ResultStore
from tallygrove.sources.file_tree import scan_visible_files

BUCKETS = 32
RUNS = 4  # of a level, before they are merged
BITS_PER_KEY = 16
PROBES = 4

_WRITTEN_ROW = "path string, content string, tokens bigint, mtime bigint, error string"
_KEYS = "path string, mtime bigint, seq bigint"
_INDEX = "bucket int, n bigint, low string, high string, bloom binary"
_INDEX_TYPE = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("low", pa.string()), ("high", pa.string()), ("bloom", pa.binary())])


def bloom_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter of `bits`, a power of two."""
    step = hashes >> np.uint64(32) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)
    return (hashes[:, None] + probes * step[:, None]) & np.uint64(bits - 1)


def bloom_filter(hashes: np.ndarray) -> bytes:
    bits = 1 << max(6, (len(hashes) * BITS_PER_KEY - 1).bit_length())
    held = np.zeros(bits, bool)
    held[bloom_places(hashes, bits).reshape(-1)] = True
    return np.packbits(held, bitorder="little").tobytes()


def bloom_holds(bloom: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the filter; none that is in is missed."""
    data = np.frombuffer(bloom, np.uint8)
    places = bloom_places(hashes, len(data) * 8)
    return (data[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)


def _path_hash() -> Column:
    return F.xxhash64("path")


class ClusteredStore(ResultStore):
    """As `ResultStore`, with rows in buckets and an index. One writer at a time."""

    def __init__(self, spark: SparkSession, location: str):
        super().__init__(spark, location)
        self.buckets = spark.read.schema("buckets int").json(f"{location}/layout").first()[0]

    @classmethod
    def create(cls, spark: SparkSession, location: str, buckets: int = BUCKETS) -> "ClusteredStore":
        """An empty store; fails if there is something. The number of buckets is fixed."""
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{location}/layout")
        store = cls(spark, location)
        store._empty("errorifexists")
        return store

    def _empty(self, mode: str) -> None:
        for name, schema, by in (
            ("contents", f"{_WRITTEN_ROW}, seq bigint, bucket int", ["seq", "bucket"]),
            ("keys", f"{_KEYS}, run string, bucket int", ["run", "bucket"]),
            ("index", f"{_INDEX}, run string", ["run"]),
        ):
            empty = self.spark.createDataFrame([], schema).write.mode(mode).option("partitionOverwriteMode", "static")
            empty.partitionBy(*by).parquet(f"{self.location}/{name}")

    def _bucket(self) -> Column:
        return F.pmod(_path_hash(), F.lit(self.buckets)).cast("int")

    # Runs are named level-first-last, by the writes they cover.

    def _runs(self, before: int | None = None) -> list:
        """[(level, first, last)] of the runs that together hold all writes before one, each once."""
        kept = []
        for level, first, last in sorted(self._named_runs(), reverse=True):
            covered = any(a <= first and last <= b for _, a, b in kept)
            if not covered and (before is None or last < before):
                kept.append((level, first, last))
        return sorted(kept, key=lambda run: run[1])

    def _named_runs(self) -> set:
        """All runs with an index, by the names of its files."""
        files = self.spark.read.schema(_INDEX).parquet(f"{self.location}/index").inputFiles()
        return {tuple(map(int, m.groups())) for f in files if (m := re.search(r"/run=(\d+)-(\d+)-(\d+)/", f))}

    def _name(self, run: tuple) -> str:
        return "-".join(map(str, run))

    def _keys(self, places: list) -> DataFrame:
        """(path, mtime, seq) in the given (run, bucket) pairs; None stands for all buckets of a run."""
        frame = self.spark.createDataFrame([], _KEYS)
        written, merged = [], []
        for run, bucket in places:
            inner = "" if bucket is None else f"/bucket={bucket}"
            if run[0]:
                merged.append(f"{self.location}/keys/run={self._name(run)}{inner}")
            else:
                written.append(f"{self.location}/contents/seq={run[1]}{inner}")
        if written:
            rows = self.spark.read.schema(STORED).option("basePath", f"{self.location}/contents").parquet(*written)
            frame = frame.unionByName(rows.select("path", "mtime", "seq"))
        if merged:
            rows = self.spark.read.schema(_KEYS).option("basePath", f"{self.location}/keys").parquet(*merged)
            frame = frame.unionByName(rows.select("path", "mtime", "seq"))
        return frame

    def touched(self, requests: DataFrame, runs: list) -> list:
        """The (run, bucket) pairs that may hold one of a few requested paths.

        Their hashes, 8 bytes a path, are sent to the tasks that look through the index.
        """
        if not runs:
            return []
        asked = requests.select(self._bucket().alias("bucket"), _path_hash().alias("hash"), "path").toArrow()
        buckets, hashes = (np.asarray(asked.column(k).to_numpy()) for k in (0, 1))
        hashes = hashes.astype(np.int64).view(np.uint64)
        ends = {}
        for bucket, path in zip(buckets.tolist(), asked.column(2).to_pylist(), strict=True):
            if path is None:
                ends[bucket] = None
            elif ends.get(bucket, "") is not None:
                low, high = ends.get(bucket) or (path, path)
                ends[bucket] = min(low, path), max(high, path)
        order = np.argsort(buckets, kind="stable")
        buckets, hashes = buckets[order], hashes[order]
        sent = self.spark.sparkContext.broadcast((buckets, hashes, ends))

        def held(batches):
            buckets, hashes, ends = sent.value
            for batch in batches:
                keep = []
                for bucket, low, high, bloom in zip(*(batch.column(n).to_pylist() for n in ("bucket", "low", "high", "bloom"))):
                    bounds = ends[bucket]
                    apart = bounds and low is not None and (bounds[1] < low or high < bounds[0])
                    a, b = np.searchsorted(buckets, [bucket, bucket + 1])
                    keep.append(not apart and bool(bloom_holds(bloom, hashes[a:b]).any()))
                yield batch.select(["run", "bucket"]).filter(pa.array(keep, pa.bool_()))

        paths = [f"{self.location}/index/run={self._name(run)}" for run in runs]
        index = self.spark.read.schema(_INDEX + ", run string").option("basePath", f"{self.location}/index").parquet(*paths)
        index = index.where(F.col("bucket").isin(sorted(ends))).select("run", "bucket", "low", "high", "bloom")
        found = index.mapInArrow(held, "run string, bucket int").collect()  # no more rows than runs have buckets
        return sorted((tuple(map(int, run.split("-"))), bucket) for run, bucket in found)

    def met(self, requests: DataFrame, before: int, exact=False, cut=None, unique=False) -> DataFrame:
        cut = ops.few(requests) if cut is None else cut
        runs = self._runs(before)
        places = self.touched(requests, runs) if cut else [(run, None) for run in runs]
        return ops.met_versions(requests, self._keys(places), exact, cut, unique)

    def hits(self, met: DataFrame, before: int) -> DataFrame:
        found = met.where("seq is not null").select("path", "seq")
        places = found.select("seq", self._bucket().alias("bucket")).distinct()
        places = places.orderBy("seq", "bucket").limit(2 * self.buckets + 1).collect()
        if not places:
            return self.spark.createDataFrame([], STORED)
        if len(places) > 2 * self.buckets:
            return keep_rows(self.log().where(F.col("seq") < before), found, ["path", "seq"])
        paths = [f"{self.location}/contents/seq={seq}/bucket={bucket}" for seq, bucket in places]
        rows = self.spark.read.schema(STORED).option("basePath", f"{self.location}/contents").parquet(*paths)
        # Spark knows how small the written `met` is, and broadcasts it where it is.
        named = found.toDF("_path", "_seq")
        same = F.col("path").eqNullSafe(F.col("_path")) & (F.col("seq") == F.col("_seq"))
        return rows.select(*STORED.names).join(named, same, "left_semi")

    def is_empty(self, before: int) -> bool:
        return not self._runs(before)

    def log(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(f"{self.location}/contents").select(*STORED.names)

    def next_seq(self) -> int:
        return 1 + max((last for _, _, last in self._named_runs()), default=0)

    def append(self, results: DataFrame, seq: int | None = None) -> int:
        seq = self.next_seq() if seq is None else seq
        rows = results.where(F.col("error").isNull()).select(*_WRITTEN.fieldNames())
        rows = rows.withColumn("bucket", self._bucket()).repartition("bucket")
        rows = rows.sortWithinPartitions("bucket", "path")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(self._directory(seq))
        covering = [run for run in self._named_runs() if run[0] and run[1] <= seq <= run[2]]
        self._write_index((0, seq, seq))
        for run in sorted(covering):  # an earlier write was replaced
            self._merge(self._below(run), run)
        self._compact_runs()
        return seq

    def _write_index(self, run: tuple) -> None:
        """One row a bucket: filter and bounds of its paths. A run without rows has none, and isn't seen."""

        def indexed(group: pa.Table) -> pa.Table:
            paths = group.column("path")
            ends = [None, None]
            if not paths.null_count:  # a null path has no place between bounds
                ends = [f(paths.to_pylist()) for f in (min, max)]
            bloom = bloom_filter(group.column("hash").to_numpy().view(np.uint64))
            return pa.Table.from_pylist([dict(zip(_INDEX_TYPE.names, (group.column("bucket")[0].as_py(), len(group), *ends, bloom)))], _INDEX_TYPE)

        keys = self._keys([(run, None)]).withColumn("bucket", self._bucket()).select("bucket", "path", _path_hash().alias("hash"))
        index = keys.groupBy("bucket").applyInArrow(indexed, _INDEX)
        index.coalesce(1).write.mode("overwrite").parquet(f"{self.location}/index/run={self._name(run)}")

    def _below(self, run: tuple) -> list:
        """The runs a merged one was made of."""
        level, first, last = run
        return sorted(r for r in self._named_runs() if r[0] == level - 1 and first <= r[1] and r[2] <= last)

    def _merge(self, runs: list, into: tuple) -> None:
        keys = ops.latest_versions(self._keys([(run, None) for run in runs])).withColumn("bucket", self._bucket())
        keys = keys.repartition("bucket").sortWithinPartitions("bucket", "path")
        keys.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.location}/keys/run={self._name(into)}")
        self._write_index(into)

    def _compact_runs(self) -> None:
        level, runs = 0, self._runs()
        while some := [run for run in runs if run[0] == level]:
            while len(some) >= RUNS:
                self._merge(some[:RUNS], (level + 1, some[0][1], some[RUNS - 1][2]))
                some = some[RUNS:]
            level, runs = level + 1, self._runs()

    def clear(self) -> None:
        self._empty("overwrite")

    def info(self) -> DataFrame:
        files = scan_visible_files(self.spark, self.location)
        return ops.store_info(self.log(), files.where(~F.col("path").contains("/layout/")))

    def compact(self, location: str) -> "ClusteredStore":
        compacted = ClusteredStore.create(self.spark, location, self.buckets)
        compacted.append(self.latest(), seq=self.next_seq() - 1)
        return compacted

    def _directory(self, seq: int) -> str:
        return os.path.join(self.location, "contents", f"seq={seq}")
