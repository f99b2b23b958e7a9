"""What the operators share: reading tables, batches of a bounded size, drawn training rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows and bytes of a batch that crosses to Python. A single longer text is a batch of its own.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches of this session's later jobs by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def only(df: DataFrame, **columns) -> DataFrame:
    """The named columns alone, cast: only(df, doc_id="bigint", text="string").

    Whatever else the caller's table holds cannot clash with what an operator adds.
    """
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


def numbered(df: DataFrame) -> DataFrame:
    """The same columns named by their place, so that no name of the caller's can clash."""
    return df.toDF(*[f"c{place}" for place in range(len(df.columns))])


def extended(df: DataFrame, **columns) -> T.StructType:
    """The schema of `df` with the named columns added, given as DDL types."""
    added = [T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in columns.items()]
    return T.StructType([*df.schema.fields, *added])


def utf8(column: pa.Array) -> list:
    """Bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def released(batches):
    """The batches as they are; what Arrow has freed goes back to the system before each next one."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


def packed(column: pa.Array):
    """The bytes of all texts of a column on end, and the offsets where each begins."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0]


def crc(doc_id="doc_id"):
    """crc32 of an id's decimal text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def drawn_rows(documents: DataFrame, labels: DataFrame, label: str, train, per_class: int) -> DataFrame:
    """(text, label) of at most `per_class` labelled rows for each of the classes 0 and 1.

    `train` is a condition on `doc_id`. The rows are those with the smallest hashes of their id,
    so equal tables give equal samples; an id counts once, with its larger label and smaller text.
    Only (id, label) pairs are ranked, by a top-N a task, and only the drawn pairs, bounded by
    `per_class`, are broadcast.
    """
    wanted = labels.select(F.col("doc_id").cast("bigint"), F.col(label).cast("int").alias("label"))
    wanted = wanted.where(train & F.col("doc_id").isNotNull()).withColumn("_rank", F.xxhash64("doc_id"))
    classes = [
        wanted.where(F.col("label") == value).orderBy("_rank", "doc_id").limit(per_class)
        for value in (0, 1)
    ]
    pairs = classes[0].union(classes[1]).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = only(documents, doc_id="bigint", text="string").join(F.broadcast(pairs), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")
