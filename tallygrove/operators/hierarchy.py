"""Token rollup along path components, and its listing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.operators.paths import (
    ancestor_keys,
    components,
    depth,
    name_of,
    node_key,
    parent_key,
)
from tallygrove.operators.skew import join_lookup
from tallygrove.session import materialise

# The parts of a tree line.
BRANCH, LAST_BRANCH = "├── ", "└── "
BAR, GAP = "│   ", "    "


def _leaves(measured: DataFrame, order_col: str | None, unique: bool) -> DataFrame:
    """(key, tokens) once per path: of repeated paths the last row."""
    keyed = measured.withColumn("key", node_key(F.col("path")))
    if unique:
        return keyed.select("key", "tokens")
    if order_col is None and "pos" not in measured.columns:
        keyed = keyed.withColumn("pos", F.monotonically_increasing_id())
    return keyed.groupBy("key").agg(F.max_by("tokens", order_col or "pos").alias("tokens"))


def _nodes(measured: DataFrame, order_col: str | None, unique: bool) -> DataFrame:
    """(key, tokens, is_dir) of all files and directories, from one pass over the files.

    Every file adds its tokens to each ancestor and is a row of its own. Ancestors are
    summed map-side, so the exchange carries about one row per file, and one per directory
    and task. A path that is also a directory loses its own tokens: the few such rows are
    taken off their ancestors again.
    """
    tokens = F.col("tokens")
    none = F.lit(None).cast("bigint")
    above = F.transform(
        ancestor_keys(F.col("key")),
        lambda key: F.struct(key.alias("key"), tokens.alias("below"), none.alias("own")),
    )
    itself = F.array(F.struct("key", none.alias("below"), tokens.alias("own")))
    sums = (
        _leaves(measured, order_col, unique)
        .select(F.inline(F.concat(above, itself)))
        .groupBy("key")
        .agg(F.sum("below").alias("below"), F.sum("own").alias("own"))
    )
    both = sums.where("below is not null and own is not null")
    excess = (
        both.select(F.explode(ancestor_keys(F.col("key"))).alias("key"), "own")
        .groupBy("key")
        .agg(F.sum("own").alias("excess"))
    )
    is_dir = F.col("below").isNotNull()
    net = F.col("below") - F.coalesce("excess", F.lit(0))
    return sums.join(excess, "key", "left").select(
        "key", F.when(is_dir, net).otherwise(F.col("own")).alias("tokens"), is_dir.alias("is_dir")
    )


def rollup(measured: DataFrame, order_col: str | None = None, unique: bool = False) -> DataFrame:
    """(node, parent, name, depth, tokens): a directory has the tokens of all files below.

    The root is the empty array. Of a repeated path the last row wins, by `order_col`, else by
    `pos`, else in the order of the rows. `unique` says that no path repeats.
    """
    key = F.col("key")
    node = components(key)
    return _nodes(measured, order_col, unique).select(
        node.alias("node"),
        F.when(key != "", F.slice(node, 1, depth(key) - 1)).alias("parent"),
        name_of(key).alias("name"),
        depth(key).cast("int").alias("depth"),
        F.col("tokens").cast("bigint").alias("tokens"),
    )


def last_children(nodes: DataFrame) -> DataFrame:
    """(node) of every directory's last child.

    One maximum per directory, combined map-side, instead of a window that would sort all
    children of one directory in one task.
    """
    last = nodes.where("depth > 0").groupBy("parent").agg(F.max("name").alias("name"))
    return last.select(F.concat("parent", F.array("name")).alias("node"))


def pre_order(nodes: DataFrame) -> DataFrame:
    """Depth first, siblings by name."""
    return nodes.orderBy("node")


def tree_lines(measured: DataFrame, order_col: str | None = None, unique: bool = False) -> DataFrame:
    """(node, line) of the drawn tree, to be ordered by `node`.

    Nodes without a name, the root among them, print nothing and indent nothing. The nodes
    are written to the scratch folder first. All that a line needs to know beyond its node
    is one row per directory: the name of the last child and the indent of all children.
    """
    key, name = F.col("key"), F.col("name")
    nodes = materialise(_nodes(measured, order_col, unique)).where("key <> ''")
    nodes = nodes.withColumn("parent", parent_key(key)).withColumn("name", name_of(key))
    is_last = name == F.col("last")
    lasts = materialise(nodes.groupBy("parent").agg(F.max("name").alias("last")))

    # What each directory adds in front of its descendants; then these along each path.
    pad = F.when(name == "", F.lit("")).when(is_last, F.lit(GAP)).otherwise(F.lit(BAR))
    dirs = nodes.where("is_dir").select("key", "parent", "name")
    pads = join_lookup(dirs, lasts, on="parent", spread_by="key").select(
        key.alias("above"), pad.alias("pad")
    )
    chain = dirs.select("key", F.explode(F.concat(ancestor_keys(key), F.array(key))).alias("above"))
    steps = F.array_sort(F.collect_list(F.struct(F.length("above").alias("at"), "pad")))
    indents = (
        join_lookup(chain.where("above <> ''"), pads, on="above", spread_by="key", how="inner")
        .groupBy(key.alias("parent"))
        .agg(F.array_join(F.transform(steps, lambda step: step["pad"]), "").alias("indent"))
    )
    children = lasts.join(indents, "parent", "left")

    line = F.concat(
        F.coalesce("indent", F.lit("")),
        F.when(is_last, F.lit(LAST_BRANCH)).otherwise(F.lit(BRANCH)),
        name,
        F.lit(" ("),
        F.col("tokens").cast("string"),
        F.lit(" tokens)"),
    )
    shown = nodes.where("name <> ''")
    return join_lookup(shown, children, on="parent", spread_by="key").select(
        components(key).alias("node"), line.alias("line")
    )
