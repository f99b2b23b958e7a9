"""The contents of many files as one text or as JSON lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.session import fits_one_wave

# The parts of the merged text.
RESULT_HEADER = "=== Result ==="
FILE_HEADER = "File: "


def in_path_order(files: DataFrame) -> DataFrame:
    """By path; rows of one path as they came, and split between tasks where they are many.

    What narrow operators add afterwards stays in order. A small input keeps one range for
    each core, as these may have work to do.
    """
    numbered = files.withColumn("_row", F.monotonically_increasing_id())
    if fits_one_wave(files):
        cores = files.sparkSession.sparkContext.defaultParallelism
        ranges = numbered.repartitionByRange(cores, "path", "_row")
        return ranges.sortWithinPartitions("path", "_row").drop("_row")
    return numbered.orderBy("path", "_row").drop("_row")


def merged_blocks(measured: DataFrame) -> DataFrame:
    """(path, block): the text each file contributes; nothing follows its content."""
    return measured.select(
        "path", F.concat(F.lit(FILE_HEADER), "path", F.lit("\n"), "content").alias("block")
    )


def merged_json(measured: DataFrame) -> DataFrame:
    """(path, json): one object a file; `error` only where it is set."""
    fields = ["path", "content", "tokens"] + [c for c in ["error"] if c in measured.columns]
    return measured.select("path", F.to_json(F.struct(*fields)).alias("json"))


def write_merged_text(measured: DataFrame, location: str, ordered: bool = True) -> None:
    """Text shards: the header, then the blocks, each ended by a newline.

    Ordered by path over all shards. The order costs one exchange of the contents; without
    it every task writes its blocks as they come, and the header is a shard of its own.
    """
    header = measured.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("path"), F.lit(RESULT_HEADER).alias("block")
    )
    # Without a path the header comes first in path order.
    lines = header.unionByName(merged_blocks(measured))
    lines = in_path_order(lines) if ordered else lines
    lines.select("block").write.text(location)


def write_merged_json(measured: DataFrame, location: str, ordered: bool = True) -> None:
    """JSON Lines shards, ordered by path if asked for."""
    fields = ["path", "content", "tokens"] + [c for c in ["error"] if c in measured.columns]
    rows = measured.select(*fields)
    (in_path_order(rows) if ordered else rows).write.json(location)


def write_tree(lines: DataFrame, location: str) -> None:
    """Tree lines as text shards, in order."""
    lines.orderBy("node").select("line").write.text(location)
