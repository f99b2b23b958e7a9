"""Scalar columns: blank test, paths, versions, report cells."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode property White_Space, as the inside of
# a Java character class. Java's own \s and Spark's trim() know only ASCII blanks.
WHITE_SPACE = (
    r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

BYTES_IN_MB = 1048576


def is_blank(text: Column) -> Column:
    """Empty or white space only. Stops at the first visible character."""
    return ~text.rlike(f"[^{WHITE_SPACE}]")


def relative_path(path: Column, root: str) -> Column:
    """`path` below `root`; unchanged if it is not below it."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def path_components(path: Column) -> Column:
    """Parts between slashes; a leading slash gives an empty first part."""
    return F.split(path, "/", -1)


def version_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch; earlier times are 0."""
    return F.greatest(F.unix_seconds(ts.cast("timestamp")), F.lit(0).cast("bigint"))


def whole_mb(size: Column) -> Column:
    return F.round(size / F.lit(float(BYTES_IN_MB)))


def left_cell(text: Column, width: Column) -> Column:
    """Pad on the right to `width` bytes."""
    return F.concat(text, F.repeat(F.lit(" "), (width - F.octet_length(text)).cast("int")))


def right_cell(number: Column, width: int = 8) -> Column:
    """Pad on the left to `width`; longer numbers stay whole (Spark's lpad would cut them)."""
    text = number.cast("string")
    return F.concat(F.repeat(F.lit(" "), F.lit(width) - F.length(text)), text)
