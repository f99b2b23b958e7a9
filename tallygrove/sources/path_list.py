"""A list of paths, and its lookup in a corpus."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions.text import is_blank
from tallygrove.operators.skew import is_small, join_salted
from tallygrove.sources.decode import READ_ERROR


def path_list(lines: DataFrame) -> DataFrame:
    """(pos, path) of a `value` column: blank lines go, other lines stay untrimmed.

    `pos` grows along the list and tells apart repeated requests. Path rules do not apply
    to listed paths.
    """
    return lines.select(
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("path")
    ).where(~is_blank(F.col("path")))


def read_path_list(spark: SparkSession, location: str) -> DataFrame:
    return path_list(spark.read.text(location))


def lookup_paths(requests: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row per request with the corpus columns; an unknown path gets an `error`.

    `corpus` holds each path once. It is cut down to the listed paths first, without moving
    it if the list is small. A path requested very often is salted.
    """
    paths = requests.select("path")
    few = is_small(paths)
    listed = corpus.join(F.broadcast(paths) if few else paths.distinct(), "path", "left_semi")
    listed = listed.withColumn("_found", F.lit(True))
    if few:
        found = requests.join(listed, "path", "left")  # too few for a hot path
    else:
        found = join_salted(requests, listed, on="path", spread_by="pos")
    earlier = F.col("error") if "error" in corpus.columns else F.lit(None).cast("string")
    return found.withColumn(
        "error", F.when(F.col("_found").isNull(), F.lit(READ_ERROR)).otherwise(earlier)
    ).drop("_found")
