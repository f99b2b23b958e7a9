"""Session settings and the shared scratch folder."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole documents go through Arrow: bound a batch by bytes as well as by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def build_session(cores="*", app="tallygrove", **settings) -> SparkSession:
    """A local session for tests and benches; on a cluster, pass SETTINGS to spark-submit."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in `spark.checkpoint.dir`.

    Only where that is unset (tests, a laptop) a local folder is made and set.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="tallygrove-")
        spark.sparkContext.setCheckpointDir(shared)
    return os.path.join(shared, f"tallygrove-{uuid.uuid4().hex}")


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate; the size of its files for a table as it was written."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_one_wave(df: DataFrame) -> bool:
    """Less than one full-size scan partition per core."""
    spark = df.sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return estimated_bytes(df) < spark.sparkContext.defaultParallelism * split


def spread(df: DataFrame) -> DataFrame:
    """Even out an input too small to fill the cluster, e.g. one file with one row group.

    A larger one is returned as it is, so a large corpus is never shuffled for this.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if fits_one_wave(df) else df


def materialise(df: DataFrame) -> DataFrame:
    """The same rows as a table in the scratch folder.

    For rows that several branches read: they are computed once, each branch then reads the
    columns it needs, and a lost executor costs no recomputation of what lies before. Spark
    knows the size of a table, and so broadcasts it in a join only where it is small.
    """
    location = scratch_dir(df.sparkSession)
    df.write.parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)
