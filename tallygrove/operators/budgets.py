"""Token budgets per file."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BUDGET = 0
MAX_BUDGET = 10_000


def apply_budgets(
    measured: DataFrame,
    min_tokens: int = MIN_BUDGET,
    max_tokens: int = MAX_BUDGET,
    limit_high: bool = False,
    limit_low: bool = False,
) -> DataFrame:
    """Drop rows without tokens, always; both bounds are inclusive and off by default."""
    tokens = F.col("tokens")
    keep = tokens > 0
    if limit_low:
        keep = keep & (tokens >= min_tokens)
    if limit_high:
        keep = keep & (tokens <= max_tokens)
    return measured.where(keep)


def drop_empty(measured: DataFrame) -> DataFrame:
    """`apply_budgets` without limits for normalised files, of which only '' has no tokens.

    So they need not be counted first.
    """
    return measured.where(F.col("content") != "")


def prune_by_length(
    files: DataFrame,
    length: Column,
    min_tokens: int | None = None,
    max_tokens: int | None = None,
    longest_token: int | None = None,
) -> DataFrame:
    """Rows whose length in bytes leaves them a chance to meet the budgets.

    A token covers at least one byte, and at most `longest_token` if the vocabulary (with
    its special tokens) is known. Necessary conditions, to spare the measure; the exact
    filter comes after it.
    """
    if min_tokens is not None:
        files = files.where(length >= min_tokens)
    if max_tokens is not None and longest_token is not None:
        files = files.where(length <= max_tokens * longest_token)
    return files
