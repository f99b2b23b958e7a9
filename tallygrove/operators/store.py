"""The result store: an append log of measured files keyed by (path, version).

Requests and log meet in joins of their keys and versions only. Contents come last, for the
rows then known to be needed; (path, seq) is unique in a log, `pos` in requests. A null path
is a path like any other.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.text import whole_mb
from tallygrove.operators.skew import is_small, join_salted, keep_rows


def latest_versions(log: DataFrame) -> DataFrame:
    """(path, mtime, seq) of the last write of every path, whatever its mtime."""
    return log.groupBy("path").agg(
        F.max_by("mtime", "seq").alias("mtime"), F.max("seq").alias("seq")
    )


def latest_rows(log: DataFrame) -> DataFrame:
    """The store as a table: the last write of every path."""
    return keep_rows(log, latest_versions(log).select("path", "seq"), ["path", "seq"])


def wanted_versions(requests: DataFrame, unique: bool = False) -> DataFrame:
    """(path, wanted, pos): each requested path once, at its newest version, last asked."""
    if unique:
        return requests.select("path", F.col("mtime").alias("wanted"), "pos")
    newest = F.max(F.struct("mtime", "pos"))
    return (
        requests.groupBy("path")
        .agg(newest.alias("newest"))
        .select("path", F.col("newest.mtime").alias("wanted"), F.col("newest.pos").alias("pos"))
    )


def few(requests: DataFrame) -> bool:
    """Few enough for their paths to be broadcast."""
    return is_small(requests.select("path"))


def met_versions(
    requests: DataFrame,
    log: DataFrame,
    exact: bool = False,
    cut: bool | None = None,
    unique: bool = False,
) -> DataFrame:
    """(path, wanted, pos, seq): wanted versions with the `seq` of the write that answers them, null for a miss.

    A stored version answers if it is as new as the wanted one. `exact` asks for the very
    version instead, so that a restored older file is a miss. For few requests the log is
    first cut down to their paths, without an exchange.
    """
    if few(requests) if cut is None else cut:
        asked = F.broadcast(requests.select(F.col("path").alias("_asked")))
        log = log.join(asked, F.col("path").eqNullSafe(F.col("_asked")), "left_semi")
    stored = latest_versions(log)
    mtime, wanted = F.col("mtime"), F.col("wanted")
    meets = mtime == wanted if exact else mtime >= wanted
    stored = stored.withColumnRenamed("path", "_path")
    return (
        wanted_versions(requests, unique)
        .join(stored, F.col("path").eqNullSafe(F.col("_path")), "left")
        .select("path", "wanted", "pos", F.when(meets, F.col("seq")).alias("seq"))
    )


def lookup_hits(
    requests: DataFrame,
    log: DataFrame,
    exact: bool = False,
    cut: bool | None = None,
    unique: bool = False,
) -> DataFrame:
    """Stored rows, once for every requested path that hits. Requests: (pos, path, mtime, …).

    `cut` is the value of `few(requests)`, if known; `unique` says that no path repeats.
    """
    return hits_of(met_versions(requests, log, exact, cut, unique), log)


def hits_of(met: DataFrame, log: DataFrame) -> DataFrame:
    """The stored rows that `met_versions` found."""
    return keep_rows(log, met.where("seq is not null").select("path", "seq"), ["path", "seq"])


def lookup_misses(
    requests: DataFrame,
    log: DataFrame,
    exact: bool = False,
    cut: bool | None = None,
    unique: bool = False,
) -> DataFrame:
    """Requests without a hit, each path once, at its newest version."""
    return misses_of(met_versions(requests, log, exact, cut, unique), requests)


def misses_of(met: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests that `met_versions` found nothing for."""
    return keep_rows(requests, met.where("seq is null").select("pos"), ["pos"])


def answer(requests: DataFrame, results: DataFrame, cut: bool | None = None) -> DataFrame:
    """One result row per request; repeated requests get equal rows, paths may be hot.

    `requests` has (pos, path); `results` each path once.
    """
    wanted = requests.select("pos", _named("path").alias("_key"))
    results = results.withColumn("_key", _named("path"))
    if few(requests) if cut is None else cut:
        return wanted.join(results, "_key").drop("_key")  # too few for a hot path
    return join_salted(wanted, results, on="_key", spread_by="pos", how="inner").drop("_key")


def _named(path: str):
    """A string for every path, none included."""
    return F.when(F.col(path).isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), path))


def store_info(log: DataFrame, files: DataFrame) -> DataFrame:
    """(records, allocated, mb): paths in the log, and the `length` of all files that hold it."""
    records = log.agg(F.countDistinct("path").alias("records"))
    allocated = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("allocated"))
    info = records.select("records", allocated.scalar().cast("bigint").alias("allocated"))
    return info.withColumn("mb", whole_mb(F.col("allocated")))
