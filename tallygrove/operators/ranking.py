"""Orders, top-N and totals over measured files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOP = 10


def by_tokens(measured: DataFrame) -> DataFrame:
    """(path, tokens), most tokens first; ties by path.

    A sort samples its input before it reads it. The exchange before it holds the two
    columns, so that the texts are measured once. The row number lets equal rows, however
    many, be split between tasks.
    """
    slim = measured.select("path", "tokens").hint("rebalance")
    return slim.orderBy(F.desc("tokens"), "path", F.monotonically_increasing_id())


def top_files(measured: DataFrame, n: int = DEFAULT_TOP) -> DataFrame:
    """(path, tokens) of the n largest files: a bounded heap per task, no full sort."""
    return measured.select("path", "tokens").orderBy(F.desc("tokens"), "path").limit(n)


def token_total(measured: DataFrame) -> DataFrame:
    """Tokens of all rows; 0 if there are none."""
    return measured.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("total"))


def widest_path(measured: DataFrame) -> DataFrame:
    """Longest path in bytes; 0 if there are none."""
    width = F.max(F.octet_length("path"))
    return measured.agg(F.coalesce(width, F.lit(0)).cast("bigint").alias("width"))
