"""Include / ignore globs and named rule sets."""

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions.globs import globs_to_regex
from tallygrove.schemas import RULE_SET_FILE

INCLUDE_ALL = ("**",)
RULE_SET_VERSION = 1


@dataclass(frozen=True)
class RuleSet:
    """A named pair of pattern lists."""

    name: str = "default"
    filters: Sequence[str] = INCLUDE_ALL
    ignores: Sequence[str] = field(default=())


def read_rule_sets(spark: SparkSession, location: str) -> list[RuleSet]:
    """Rule sets of a JSON configuration {"version": 1, "contexts": [{context, filters, ignores}]}."""
    config = spark.read.schema(RULE_SET_FILE).json(location, multiLine=True).first()
    if config is None or config["version"] != RULE_SET_VERSION:
        raise ValueError(f"Unsupported rule set version: {config and config['version']}")
    return [
        RuleSet(
            row["context"],
            tuple(INCLUDE_ALL if row["filters"] is None else row["filters"]),
            tuple(row["ignores"] or ()),
        )
        for row in config["contexts"] or ()
    ]


def pick_rule_set(rule_sets: Sequence[RuleSet], name: str = "default") -> RuleSet:
    """The first rule set of exactly this name."""
    for rule_set in rule_sets:
        if rule_set.name == name:
            return rule_set
    raise ValueError(f"Rule set '{name}' not found")


def effective_rules(
    include: Sequence[str] = (), ignore: Sequence[str] = (), rule_set: RuleSet | None = None
) -> RuleSet:
    """Each list of the caller wins as a whole; an empty one falls back to the rule set."""
    base = rule_set or RuleSet()
    return RuleSet(base.name, tuple(include) or base.filters, tuple(ignore) or base.ignores)


def matches(path: Column, patterns: Sequence[str]) -> Column:
    regex = globs_to_regex(patterns)
    return F.lit(False) if regex is None else path.rlike(regex)


def admits(path: Column, rule_set: RuleSet) -> Column:
    return matches(path, rule_set.filters) & ~matches(path, rule_set.ignores)


def select_paths(
    files: DataFrame,
    include: Sequence[str] = INCLUDE_ALL,
    ignore: Sequence[str] = (),
    relative: Column | None = None,
) -> DataFrame:
    """Rows that some include and no ignore pattern covers.

    Patterns see `relative` (default: the path). A pattern that is not valid raises here,
    before any job.
    """
    path = F.col("path") if relative is None else relative
    return files.where(admits(path, RuleSet("", tuple(include), tuple(ignore))))


def select_by_rule_sets(files: DataFrame, rule_sets: Sequence[RuleSet]) -> DataFrame:
    """(context, …): every file once per rule set that admits it, in one pass and without a join."""
    named = {}
    for rule_set in rule_sets:
        named.setdefault(rule_set.name, rule_set)
    admitted = F.array_compact(
        F.array(*(F.when(admits(F.col("path"), r), F.lit(r.name)) for r in named.values()))
    )
    return files.select(F.explode(admitted).alias("context"), "*")
