"""The runs a user starts: select, measure, filter by budget, then merge, draw or report."""

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions.text import relative_path
from tallygrove.operators.budgets import (
    MAX_BUDGET,
    MIN_BUDGET,
    apply_budgets,
    drop_empty,
    prune_by_length,
)
from tallygrove.operators.hierarchy import tree_lines
from tallygrove.operators.ignore_rules import (
    EXCLUDE_FILE,
    IGNORE_FILES,
    drop_ignored,
    is_ignore_file,
    parse_ignore_files,
    repositories,
)
from tallygrove.operators.measure import measure, normalise
from tallygrove.operators.path_rules import RuleSet, effective_rules, select_paths
from tallygrove.operators.ranking import DEFAULT_TOP
from tallygrove.plans.incremental import incremental_run
from tallygrove.session import materialise
from tallygrove.sinks.merged import in_path_order, merged_blocks, merged_json
from tallygrove.sinks.reports import report_json, report_lines
from tallygrove.sinks.store import ResultStore
from tallygrove.sources.decode import decode_utf8
from tallygrove.sources.file_tree import list_files, read_contents, stat_files
from tallygrove.sources.path_list import read_path_list


@dataclass(frozen=True)
class Options:
    """What to select and which budgets to apply. Budgets are per file.

    Ignore files of the git kinds count inside repositories only, unless that is lifted.
    """

    include: Sequence[str] = ()
    ignore: Sequence[str] = ()
    rule_set: RuleSet | None = None
    ignore_files: bool = True
    repositories_only: bool = True
    min_tokens: int = MIN_BUDGET
    max_tokens: int = MAX_BUDGET
    limit_high: bool = False
    limit_low: bool = False


def read_text(listing: DataFrame) -> DataFrame:
    """Adds `content` and `error` to the files of a listing."""
    return decode_utf8(read_contents(listing))


def select_files(spark: SparkSession, root: str, options: Options = Options()) -> DataFrame:
    """(path, length, mtime) of the files under `root` that all path rules admit.

    Of the contents only those of ignore files are read.
    """
    walk = IgnoringWalk(spark, root, options.repositories_only) if options.ignore_files else None
    listing = list_files(spark, root, prune=walk and walk.prune)
    rules = effective_rules(options.include, options.ignore, options.rule_set)
    chosen = select_paths(listing, rules.filters, rules.ignores, relative_path(F.col("path"), root))
    return walk.kept(chosen) if walk else chosen


class IgnoringWalk:
    """Ignore rules as they come up on the way down a tree: an ignored directory is not listed.

    Paths count from the top of the file system, as rules above `root` hold, too. On every level
    the ignore files among its entries are read before its directories are judged, so a
    directory meets all rules that may speak of it. Each level's rules are a small written table.
    """

    def __init__(self, spark: SparkSession, root: str, repositories_only: bool = True):
        self.spark, self.root, self.repositories_only = spark, root, repositories_only
        self.host, self.top = _place(root)
        above = _above(spark, self.host, self.top)
        self.rules = self.tops = None
        self._learn(above)

    def _placed(self, paths: DataFrame) -> DataFrame:
        inner = relative_path(F.col("path"), self.root)
        return paths.withColumn("place", F.concat(F.lit(self.top + "/" if self.top else ""), inner))

    def _learn(self, speaking: DataFrame) -> None:
        """Rules and repositories of a listing, with `place`, of ignore files and `.git` entries."""
        speaking = materialise(speaking)
        if speaking.isEmpty():
            return
        files = read_text(speaking.where(is_ignore_file(F.col("place"))))
        rules = materialise(parse_ignore_files(files.select(F.col("place").alias("path"), "content")))
        tops = materialise(repositories(speaking.select(F.col("place").alias("path"))))
        self.rules = rules if self.rules is None else self.rules.unionByName(rules)
        self.tops = tops if self.tops is None else self.tops.unionByName(tops)

    def prune(self, entries: DataFrame) -> DataFrame:
        """Those directories of a level that no rule hides."""
        placed = self._placed(entries)
        git = F.col("place").rlike(r"(^|/)\.git$")
        speaking = placed.where((~F.col("is_dir") & is_ignore_file(F.col("place"))) | git)
        # What a repository's own file excludes is two levels further down.
        excludes = [F.concat(c, F.lit("/info/exclude")).alias(c) for c in ("path", "place")]
        exclude = stat_files(speaking.where(git).select(*excludes), tasks=1).where("length is not null")
        self._learn(speaking.select("path", "place", "length", "mtime").unionByName(exclude))
        return self.kept(entries.where("is_dir"), is_dir=True)

    def kept(self, paths: DataFrame, is_dir: bool = False) -> DataFrame:
        """Those of (path, …) that no rule known so far hides."""
        if self.rules is None:
            return paths
        placed = self._placed(paths.withColumn("full", F.col("path"))).withColumn("path", F.col("place")).drop("place")
        tops = self.tops if self.repositories_only else None
        found = drop_ignored(placed, self.rules, tops, self.top, is_dir)
        return found.withColumn("path", F.col("full")).drop("full")


def _place(root: str) -> tuple[str, str]:
    """What comes before the top of the file system, and the path of `root` below it."""
    if "://" in root:
        scheme, rest = root.split("://", 1)
        host, _, path = rest.partition("/")
        return f"{scheme}://{host}/", path.strip("/")
    return "/", os.path.abspath(root).strip("/")


def _above(spark: SparkSession, host: str, top: str) -> DataFrame:
    """A listing, with `place`, of what may speak for `top` in the directories above it."""
    names = [*IGNORE_FILES, EXCLUDE_FILE.strip("/"), ".git"]
    parts = top.split("/") if top else []
    places = ["/".join([*parts[:k], name]) for k in range(len(parts)) for name in names]
    candidates = spark.createDataFrame([(host + p, p) for p in places], "path string, place string")
    return stat_files(candidates, tasks=1).where("length is not null")


def measured_files(
    spark: SparkSession,
    root: str,
    options: Options = Options(),
    vocab: DataFrame | None = None,
    store: ResultStore | None = None,
) -> DataFrame:
    """(path, content, tokens, error) of the selected files within budget."""
    listing = select_files(spark, root, options)
    if options.limit_low:
        listing = prune_by_length(listing, F.col("length"), options.min_tokens)
    return _measured(listing.withColumn("pos", F.col("path")), options, vocab, store, unique=True)


def listed_files(
    spark: SparkSession,
    list_location: str,
    options: Options = Options(),
    vocab: DataFrame | None = None,
    store: ResultStore | None = None,
) -> DataFrame:
    """The same for the files named in a list, with `pos`, one row per line. Only budgets apply."""
    requests = stat_files(read_path_list(spark, list_location))
    return _measured(requests, options, vocab, store, unique=False)


def _measured(requests, options, vocab, store, unique):
    requests = materialise(requests)  # slim, and read more than once
    if store is None:
        measured = measure(read_text(requests), vocab, table=False)
    else:
        measured = incremental_run(requests, store, vocab, read=read_text, unique=unique)
    measured = measured.select(*([] if unique else ["pos"]), "path", "content", "tokens", "error")
    if options.limit_low or options.limit_high:
        return within_budget(measured, options)
    return drop_empty(measured)


def within_budget(measured: DataFrame, options: Options) -> DataFrame:
    return apply_budgets(
        measured, options.min_tokens, options.max_tokens, options.limit_high, options.limit_low
    )


def merge_files(
    files: DataFrame,
    form: str = "text",
    options: Options = Options(),
    vocab: DataFrame | None = None,
) -> DataFrame:
    """Blocks of the merged output of (path, content, …), in path order, not measured before.

    A sort reads its input twice. So it comes before the measure, which then runs once, and
    not at all for text without budgets. With budgets the ranges of the sort are quantiles of
    the paths alone, so it comes before the measure as well.
    """
    files = in_path_order(files)
    if options.limit_low or options.limit_high:
        return merge(within_budget(measure(files, vocab, table=False), options), form, ordered=False)
    files = normalise(files) if form == "text" else measure(files, vocab, table=False)
    return merge(drop_empty(files), form, ordered=False)


def merge(measured: DataFrame, form: str = "text", ordered: bool = True) -> DataFrame:
    """Blocks of the merged output, in path order unless that is not needed."""
    if form == "text":
        blocks = merged_blocks(measured)
    elif form == "json":
        blocks = merged_json(measured)
    else:
        raise ValueError(f"Unsupported format: {form}")
    return in_path_order(blocks) if ordered else blocks


def tree(measured: DataFrame, order_col: str | None = None, unique: bool = False) -> DataFrame:
    """Lines of the drawn tree, in order. Of repeated paths the last wins, as in `rollup`."""
    return tree_lines(measured, order_col, unique).orderBy("node")


def tokens(measured: DataFrame, n: int = DEFAULT_TOP, form: str = "plain") -> DataFrame:
    """The token report."""
    if form == "plain":
        return report_lines(measured, n)
    if form == "json":
        return report_json(measured, n)
    raise ValueError(f"Unsupported format: {form}")
