"""Any table with key columns, a text and a version, as files."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_files(table: DataFrame, keys: list, content, mtime=None) -> DataFrame:
    """(path, content[, mtime]): the path is the keys joined by slashes."""
    parts = [key if isinstance(key, Column) else F.col(key) for key in keys]
    content = content if isinstance(content, Column) else F.col(content)
    out = [F.concat_ws("/", *parts).alias("path"), content.alias("content")]
    if mtime is not None:
        out.append(mtime.cast("bigint").alias("mtime"))
    return table.select(*out)
