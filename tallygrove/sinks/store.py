"""Parquet files of the result store, one directory `seq=N` per write."""

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.operators import store as ops
from tallygrove.schemas import STORED
from tallygrove.sources.file_tree import scan_visible_files

_WRITTEN = T.StructType([field for field in STORED.fields if field.name != "seq"])


class ResultStore:
    """A store under one location. One writer at a time; readers see whole writes.

    A write replaces its own directory only, so that a repeated attempt leaves the same
    rows, and a failed write fails the job.
    """

    def __init__(self, spark: SparkSession, location: str):
        self.spark = spark
        self.location = location

    @classmethod
    def create(cls, spark: SparkSession, location: str) -> "ResultStore":
        """An empty store; fails if there is something."""
        spark.createDataFrame([], STORED).write.partitionBy("seq").parquet(location)
        return cls(spark, location)

    def log(self) -> DataFrame:
        """Everything ever written and not cleared."""
        return self.spark.read.schema(STORED).parquet(self.location)

    def latest(self) -> DataFrame:
        return ops.latest_rows(self.log())

    def next_seq(self) -> int:
        """The number after the last write's, by the names of the files."""
        found = (re.search(r"/seq=(\d+)/", name) for name in self.log().inputFiles())
        return 1 + max((int(seq[1]) for seq in found if seq), default=0)

    def is_empty(self, before: int) -> bool:
        return self.log().where(F.col("seq") < before).isEmpty()

    def met(self, requests: DataFrame, before: int, exact=False, cut=None, unique=False) -> DataFrame:
        """(path, wanted, pos, seq) as `met_versions`, by the writes before the one numbered `before`."""
        return ops.met_versions(requests, self.log().where(F.col("seq") < before), exact, cut, unique)

    def hits(self, met: DataFrame, before: int) -> DataFrame:
        """The stored rows that `met` names."""
        return ops.hits_of(met, self.log().where(F.col("seq") < before))

    def written(self, seq: int) -> DataFrame:
        """Rows of one write."""
        rows = self.spark.read.schema(_WRITTEN).parquet(self._directory(seq))
        return rows.withColumn("seq", F.lit(seq).cast("bigint"))

    def append(self, results: DataFrame, seq: int | None = None) -> int:
        """Insert or replace by path, with paths unique in `results`. Error rows are not kept.

        Returns the number of the write. Giving it makes a repeated write harmless.
        """
        seq = self.next_seq() if seq is None else seq
        rows = results.where(F.col("error").isNull()).select(*_WRITTEN.fieldNames())
        rows.write.mode("overwrite").parquet(self._directory(seq))
        return seq

    def clear(self) -> None:
        empty = self.spark.createDataFrame([], STORED)
        # Dynamic overwriting, which a cluster may have as its default, would replace nothing.
        static = empty.write.mode("overwrite").option("partitionOverwriteMode", "static")
        static.partitionBy("seq").parquet(self.location)

    def compact(self, location: str) -> "ResultStore":
        """The latest rows as a single write of a new store; this one stays as it is."""
        compacted = ResultStore.create(self.spark, location)
        compacted.append(self.latest(), seq=self.next_seq() - 1)
        return compacted

    def info(self) -> DataFrame:
        return ops.store_info(self.log(), scan_visible_files(self.spark, self.location))

    def _directory(self, seq: int) -> str:
        return os.path.join(self.location, f"seq={seq}")
