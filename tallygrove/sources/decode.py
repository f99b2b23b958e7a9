"""Bytes to text, with an error column instead of a failing job."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READ_ERROR = "Failed to read file"
UTF8_ERROR = "Invalid UTF-8"


def decode_utf8(files: DataFrame) -> DataFrame:
    """Binary `content` to string. Missing or invalid bytes become '' and an `error`.

    An `error` column already there (a failed read) is kept.
    """
    text = F.col("content").cast("string")
    failed = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    earlier = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    error = (
        F.when(failed, earlier)
        .when(F.col("content").isNull(), F.lit(READ_ERROR))
        .when(~F.is_valid_utf8(text), F.lit(UTF8_ERROR))
    )
    return files.withColumn("error", error).withColumn(
        "content", F.when(F.col("error").isNull(), text).otherwise(F.lit(""))
    )
