"""Files to measured files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.pieces import piece_count
from tallygrove.functions.text import is_blank
from tallygrove.operators.bpe import with_bpe_tokens
from tallygrove.session import spread


def normalise(files: DataFrame) -> DataFrame:
    """Blank content, and that of error rows, becomes ''."""
    text = F.col("content")
    drop = text.isNull() | is_blank(text)
    if "error" in files.columns:
        drop = drop | F.col("error").isNotNull()
    else:
        files = files.withColumn("error", F.lit(None).cast("string"))
    return files.withColumn("content", F.when(drop, F.lit("")).otherwise(text))


def measure(files: DataFrame, vocab: DataFrame | None = None, table: bool = True) -> DataFrame:
    """Adds `tokens` (and `error`, if missing) to (path, content, …).

    With a vocabulary (token, rank) the byte-pair token count; without one the number of
    pieces, a lower bound of it. Narrow either way: contents are not shuffled, but for a
    `table` too small to fill the cluster.
    """
    files = normalise(spread(files) if table else files)
    if vocab is not None:
        return with_bpe_tokens(files, vocab)
    # A generator keeps later filters on `tokens` from repeating the regex below it.
    count = F.array(piece_count(F.col("content")))
    return files.select("*", F.explode(count).alias("tokens"))
