"""Hierarchical ignore files: per directory, last match wins, `!` re-includes.

Rules are a table keyed by the directory of their ignore file. Small ones go to all tasks as
chains; larger ones are joined with the listing by their handles, the texts that a path or its name
must be, start with or end with, so a path meets only the few rules that are likely to match it.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.functions.globs import glob_to_regex
from tallygrove.operators import skew
from tallygrove.operators.paths import ancestor_keys, name_of, node_key, parent_key
from tallygrove.operators.rule_chains import (
    ALWAYS,
    NAME,
    NAME_ENDS,
    NAME_STARTS,
    PATH,
    PATH_STARTS,
    Chains,
    handle,
)
from tallygrove.operators.skew import held_bytes, join_lookup
from tallygrove.session import materialise

# Names of ignore files with their levels; a higher level overrules a lower
# one at any depth. The exclude file speaks for the directory that holds `.git`.
EXCLUDE_FILE, EXCLUDE = "/.git/info/exclude", 0
IGNORE_FILES = {".gitignore": 1, ".ignore": 2}


@F.arrow_udf(T.StringType())
def _pattern_regex(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Regex of a pattern relative to its directory; null if it is not valid."""

    def regex(pattern):
        anchored = "/" in pattern
        if pattern.startswith("/"):
            pattern = pattern[1:]
        if pattern.endswith("/**"):
            pattern += "/*"  # what lies beneath, not the directory itself
        try:
            body = glob_to_regex(pattern, keep_slash=True)
        except ValueError:
            return None
        return rf"(?s)\A{'' if anchored else '(?:.*/)?'}(?:{body})\z"

    for batch in batches:
        yield pa.array([regex(p) for p in batch.to_pylist()], pa.string())


def _level(key: Column) -> Column:
    """Level of an ignore file; null for any other file."""
    level = F.when(key.endswith(EXCLUDE_FILE), F.lit(EXCLUDE))
    for name, value in IGNORE_FILES.items():
        level = level.when(name_of(key) == name, F.lit(value))
    return level


def is_ignore_file(path: Column) -> Column:
    return _level(node_key(path)).isNotNull()


def parse_ignore_files(files: DataFrame) -> DataFrame:
    """Rules (base, level, line, neg, dironly, rx) of the ignore files among (path, content).

    `base` is the path of the directory they hold for, '' at the top.
    """
    key = F.col("key")
    exclude = F.substring(key, F.lit(1), F.length(key) - len(EXCLUDE_FILE))
    holds_for = F.when(key.endswith(EXCLUDE_FILE), exclude).otherwise(parent_key(key))
    lines = (
        files.select(node_key(F.col("path")).alias("key"), "content")
        .withColumn("level", _level(key))
        .where("level is not null")
        .select(
            F.substring(holds_for, 2, 1 << 30).alias("base"),
            "level",
            F.posexplode(F.split("content", "\r?\n", -1)).alias("line", "value"),
        )
    )
    return compile_rules(lines)


def repositories(files: DataFrame) -> DataFrame:
    """(base) of the directories that hold a `.git`, by the paths of a listing."""
    key = node_key(F.col("path"))
    base = F.regexp_extract(key, r"^(.*?)/\.git(?:/|$)", 1)
    return (
        files.where(key.rlike(r"/\.git(?:/|$)"))
        .select(F.substring(base, 2, 1 << 30).alias("base"))
        .distinct()
    )


def compile_rules(lines: DataFrame) -> DataFrame:
    """The same of (base, level, line, value), one ignore-file line a row."""
    # Trailing blanks go unless escaped; comments and empty lines are no rules.
    text = F.regexp_replace("value", r"(?<!\\) +$", "")
    neg = F.col("text").startswith("!")
    pattern = F.regexp_replace("text", "^!", "")
    rules = (
        lines.withColumn("text", text)
        .where(F.col("text").rlike(r"^[^#]"))
        .select("base", "level", "line", neg.alias("neg"), pattern.alias("pattern"))
        .withColumn("dironly", F.col("pattern").endswith("/"))
        .withColumn("pattern", F.regexp_replace("pattern", "/$", ""))
        .where("pattern <> ''")
    )
    return (
        rules.withColumn("rx", _pattern_regex("pattern"))
        .where(F.col("rx").isNotNull())
        .select("base", "level", "line", "neg", "dironly", "rx")
    )


def _with_ancestors(key: str) -> Column:
    """Keys of all directories above, the root first, and the key itself."""
    return F.when(F.col(key) == "", F.array(key)).otherwise(
        F.concat(ancestor_keys(F.col(key)), F.array(key))
    )


def drop_ignored(
    files: DataFrame, rules: DataFrame, repositories: DataFrame | None = None, top: str = "", is_dir: bool = False
) -> DataFrame:
    """Rows of (path, …) that no ignore rule hides.

    A file goes if its own strongest rule ignores it, or if any directory above it is
    ignored, whatever rules say about what lies beneath. `base` and `path` are relative to
    the same root. With `repositories` (base), rules of the git kinds hold only below one,
    and those from above the innermost one do not reach into it. `top` is the directory the
    files were listed from: neither it nor what is above is judged, but rules from there
    hold. With `is_dir` the paths are directories.

    Rules within LOOKUP_BYTES go to every task, compiled into chains, and rows stay where they
    are. Larger tables of rules are joined by what their patterns begin or end with, with the same result.
    """
    rules = materialise(rules)
    tops = None if repositories is None else materialise(repositories.select("base").distinct())
    if held_bytes(rules) + (held_bytes(tops) if tops is not None else 0) <= skew.LOOKUP_BYTES:
        return _drop_by_chains(files, rules, tops, top, is_dir)
    return _drop_by_joins(files, rules, tops, top, is_dir)


def _base_key() -> Column:
    return F.when(F.col("base") == "", F.lit("")).otherwise(node_key(F.col("base")))


def _drop_by_chains(files, rules, tops, top, is_dir):
    held = rules.select(_base_key(), "level", "line", "neg", "dironly", "rx").collect()
    places = None if tops is None else [row[0] for row in tops.select(_base_key()).collect()]
    sent = files.sparkSession.sparkContext.broadcast((list(map(tuple, held)), places, f"/{top}" if top else ""))

    @F.arrow_udf(T.BooleanType())
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chains = Chains(*sent.value)
        gone = chains.hidden if is_dir else chains.gone
        for batch in batches:
            yield pa.array([not gone(f"/{path}") for path in batch.to_pylist()], pa.bool_())

    return files.where(kept("path"))


_HANDLE = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("whole", T.BooleanType())]
)


@F.arrow_udf(_HANDLE)
def _handle(rx: pa.Array) -> pa.Array:
    found = [handle(x) for x in rx.to_pylist()]
    kinds, texts, wholes = zip(*found, strict=True) if found else ((), (), ())
    columns = [pa.array(kinds, pa.int32()), pa.array(texts, pa.string()), pa.array(wholes, pa.bool_())]
    return pa.StructArray.from_arrays(columns, ["kind", "text", "whole"])


def _handled(rules: DataFrame) -> DataFrame:
    """(base, level, dironly, line, neg, kind, size, text, rx): `size` is -1 for a handle that is a whole
    name or path, `rx` null where the handle says all. Of equal patterns the last line is left."""
    last = F.max(F.struct("line", "neg")).alias("last")
    once = rules.select(_base_key().alias("base"), "level", "dironly", "rx", "line", "neg")
    once = once.where("base is not null").groupBy("base", "level", "dironly", "rx").agg(last)
    found = once.withColumn("found", _handle("rx"))
    kind, text = F.col("found.kind"), F.col("found.text")
    size = F.when(kind.isin(NAME, PATH), F.lit(-1)).otherwise(F.length(text))
    rx = F.when(~F.col("found.whole"), F.col("rx"))
    return found.select(
        "base", "level", "dironly", "last.line", "last.neg", kind.alias("kind"), size.alias("size"), text.alias("text"), rx.alias("rx")
    )


def _reach(dirs: DataFrame, rules: DataFrame, tops: DataFrame | None) -> DataFrame:
    """(_dir, top, bases): the directories above with rules, each with the kinds and sizes of its handles."""
    looks = rules.groupBy("base").agg(F.collect_set(F.struct("kind", "size")).alias("looks"))
    above = dirs.select("_dir", F.explode(_with_ancestors("_dir")).alias("base"))
    bases = F.collect_list(F.struct("base", "looks")).alias("bases")
    reach = join_lookup(above, looks, on="base", spread_by="_dir", how="inner").groupBy("_dir").agg(bases)
    if tops is None:
        return reach.withColumn("top", F.lit(0))
    places = tops.select(_base_key().alias("base")).distinct()
    places = join_lookup(above, places, on="base", spread_by="_dir", how="inner")
    return reach.join(places.groupBy("_dir").agg(F.max(F.length("base")).alias("top")), "_dir", "left")


def _ignored(keys: DataFrame, reach: DataFrame, rules: DataFrame, is_dir: bool) -> DataFrame:
    """(_key) of those (_key, _dir) that the strongest rule that matches ignores.

    Every key is looked up by its name, its path and their beginnings and ends of the sizes that
    handles have, so the rows of the join do not grow with the number of rules.
    """
    rules = rules if is_dir else rules.where(~F.col("dironly"))
    handle_of = F.struct("base", "kind", "text").alias("handle")
    held = rules.groupBy(handle_of).agg(
        F.sort_array(F.collect_list(F.struct("level", "line", "neg", "rx")), asc=False).alias("rules")
    )
    met = join_lookup(keys, reach, on="_dir", spread_by="_key", how="inner")
    met = met.select("_key", "top", F.explode("bases").alias("of"))
    met = met.select("_key", "top", F.col("of.base").alias("base"), F.explode("of.looks").alias("look"))
    kind, size = F.col("look.kind"), F.col("look.size")
    below = F.substring("_key", F.length("base") + 2, F.lit(1 << 30))
    subject = F.when(kind.isin(NAME, NAME_STARTS, NAME_ENDS), name_of(F.col("_key"))).otherwise(below)
    text = (
        F.when(size < 0, subject)
        .when(kind.isin(NAME_STARTS, PATH_STARTS), F.left(subject, size))
        .otherwise(F.right(subject, size))
    )
    met = met.where(F.length(subject) >= size).withColumn("handle", F.struct("base", kind.alias("kind"), text.alias("text")))
    met = join_lookup(met.select("_key", "top", "handle"), held, on="handle", spread_by="_key", how="inner")
    at = F.length("handle.base")
    below = F.substring("_key", at + 2, F.lit(1 << 30))

    def applies(rule):
        holds = (rule["level"] >= ALWAYS) | F.coalesce(at >= F.col("top"), F.lit(False))
        return holds & (rule["rx"].isNull() | F.call_function("rlike", below, rule["rx"]))

    first = F.get(F.filter("rules", applies), F.lit(0))
    met = met.select("_key", at.alias("at"), first.alias("first")).where("first is not null")
    strongest = F.max(F.struct("first.level", "at", "first.line", "first.neg")).alias("strongest")
    return met.groupBy("_key").agg(strongest).where("not strongest.neg").select("_key")


def _drop_by_joins(files, rules, tops, top, is_dir):
    keyed = files.withColumn("_key", node_key(F.col("path")))
    keys = materialise(keyed.where("_key is not null").select("_key", parent_key(F.col("_key")).alias("_dir")).distinct())
    rules = materialise(_handled(rules))
    # All directories, each with those above it that have rules.
    dirs = materialise(keys.select("_dir").distinct())
    every = dirs.select(F.explode(_with_ancestors("_dir")).alias("_dir")).distinct()
    reach = materialise(_reach(every, rules, tops))
    # A directory is judged by the rules of the one above; it hides all that is beneath.
    named = every.where(F.length("_dir") > (len(top) + 1 if top else 0)).select(F.col("_dir").alias("_key"))
    named = named.withColumn("_dir", parent_key(F.col("_key")))
    judged = _ignored(named, reach, rules, is_dir=True).select(F.col("_key").alias("base"))
    beneath = dirs.select("_dir", F.explode(_with_ancestors("_dir")).alias("base"))
    hidden = join_lookup(beneath, judged, on="base", spread_by="_dir", how="inner").select("_dir").distinct()
    gone = _ignored(keys, reach, rules, is_dir)
    gone = gone.union(join_lookup(keys, hidden, on="_dir", spread_by="_key", how="inner").select("_key"))
    keyed = keyed.withColumn("_row", F.monotonically_increasing_id())
    return join_lookup(keyed, gone.distinct(), on="_key", spread_by="_row", how="left_anti").select(*files.columns)
