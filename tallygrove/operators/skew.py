"""Joins for a very frequent key on the left, and for wide rows that should stay where they are."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.session import materialise

TASK_ROWS = 1_000_000  # a key with more rows is split, into as many parts as it has such lots

# Bounds of a checked broadcast, all on what is held in memory.
SMALL_ROWS = 200_000
SMALL_BYTES = 32 << 20
LOOKUP_BYTES = 16 << 20


def is_small(keys: DataFrame) -> bool:
    """Within both bounds. One pass over one string column, which is all it moves."""
    size = keys.agg(F.count("*"), F.sum(F.octet_length(keys.columns[0]).cast("bigint"))).first()
    return size[0] <= SMALL_ROWS and (size[1] or 0) <= SMALL_BYTES


def held_bytes(df: DataFrame) -> int:
    """What the rows take when they are held, not as compressed files: the size of their text."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint"))).first()[0] or 0


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, salts) of the keys with more than TASK_ROWS rows: at most rows / TASK_ROWS of them."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > TASK_ROWS)
    return counts.select(key, F.ceil(F.col("_n") / TASK_ROWS).cast("int").alias("_salts"))


def join_salted(
    left: DataFrame, right: DataFrame, on: str, spread_by: str, how: str = "left"
) -> DataFrame:
    """Equi-join on one column, exact, with the rows of hot left keys spread over several tasks.

    A hot key gets a salt for each TASK_ROWS of its rows, so no task has more, however many
    there are. `right` holds each key at most once; only its hot keys are replicated.
    `spread_by` tells left rows of one key apart. The list of hot keys is written, and
    broadcast if it is small.
    """
    hot = materialise(hot_keys(left, on))
    if hot.isEmpty():
        return left.join(right, on, how)
    hot = F.broadcast(hot) if is_small(hot.select(F.col(on).cast("string"))) else hot
    salt = F.pmod(F.xxhash64(spread_by), F.col("_salts")).cast("int")
    salted = left.join(hot, on, "left").withColumn("_salt", F.coalesce(salt, F.lit(0)))
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    copied = right.join(hot, on, "left").withColumn("_salt", F.explode(every))
    return salted.drop("_salts").join(copied.drop("_salts"), [on, "_salt"], how).drop("_salt")


def join_lookup(
    left: DataFrame, right: DataFrame, on: str, spread_by: str, how: str = "left"
) -> DataFrame:
    """`join_salted` for a slim `right`, e.g. one row per directory.

    It is written as a table first, and broadcast if its rows take no more than LOOKUP_BYTES.
    """
    right = materialise(right)
    if held_bytes(right) <= LOOKUP_BYTES:
        return left.join(F.broadcast(right), on, how)
    return join_salted(left, right, on, spread_by, how)


def keep_rows(rows: DataFrame, keys: DataFrame, on: list) -> DataFrame:
    """Rows whose unique key `on` is among `keys`, which all are keys of `rows`; nulls are values.

    For rows with contents: the keys and their complement are written as slim tables and the
    smaller of the two is joined, by broadcast wherever it is small. So contents move only
    if both sets are large. Either way the same rows stay.
    """
    keys = materialise(keys.select(*on))
    others = materialise(_meet(rows.select(*on), keys, on, "left_anti"))
    if others.count() < keys.count():
        return _meet(rows, others, on, "left_anti")
    return _meet(rows, keys, on, "left_semi")


def _meet(rows, keys, on, how):
    named = keys.toDF(*[f"_key_{name}" for name in on])
    same = [F.col(name).eqNullSafe(F.col(f"_key_{name}")) for name in on]
    return rows.join(named, reduce(and_, same), how)
