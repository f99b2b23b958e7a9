"""Nearest neighbours by cosine: a vantage-point tree per shard.

Vectors are dealt to shards of a bounded size. A shard's tree splits its unit vectors by their
distance to a vantage point, at the median. A search descends to a first leaf, which gives a
distance to beat, and then goes through the tree, many queries at once: by the triangle
inequality nothing below a node is nearer than `bound`, the gap between the query's distance to
the vantage point and the distances found below. A node is passed by if factor * bound is more
than the distance to beat. With factor 1 the search is exact; a larger one passes by more.

Every shard sees all queries, a block at a time, and returns each query's nearest; these meet by
query. Base vectors are shuffled once, queries once for each shard.

Vectors that are null, empty, zero, or hold a null or a component that isn't finite take no part.
Vectors of another length than the query's are no candidates. Rows with the query's own id are no
candidates either; a row repeated with the same id counts once, and of several vectors with one
id the nearest. Rows without an id take no part. Ties go to the smaller id, to 11 digits of the
cosine in the choice of candidates, to the last digit in their order. Copies of a vector are kept
as its smallest ids only, which loses none. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.llm.common import only

NEAREST = 5
FACTOR = 1.0
SHARD_ROWS = 16_384
LEAF = 128
SPARE = 8  # candidates kept beyond the nearest, before scores are taken exactly
SLACK = 1e-9


class VantageTree:
    """A tree over the rows of `vectors`, with ids; searched for blocks of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nearest: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        run = np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        repeated = np.append(False, ~new[1:] & (ids[1:] == ids[:-1]))
        kept = ~repeated & (run - _run_sum(repeated, new) <= nearest)
        self.ids, self.vectors = ids[kept], vectors[kept]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.units = self.vectors / self.norms[:, None]
        self.order = np.arange(len(self.ids))
        self.nearest = nearest
        self.root = self._build(0, len(self.ids), np.random.default_rng(0))

    def _build(self, low, high, draw):
        """(vantage row, near child, its distances, far child, its distances), or a leaf (low, high)."""
        if high - low <= LEAF:
            return low, high
        rows = self.order[low:high]
        vantage = rows[draw.integers(len(rows))]
        far = distance(self.units[rows] @ self.units[vantage])
        by_distance = np.argsort(far, kind="stable")
        self.order[low:high], far = rows[by_distance], far[by_distance]
        middle = (high - low) // 2
        return (
            vantage,
            self._build(low, low + middle, draw),
            (far[0], far[middle - 1]),
            self._build(low + middle, high, draw),
            (far[middle], far[-1]),
        )

    def search(self, query_ids, queries, factor):
        """(query number, candidate id, score): up to `nearest` a query, exact scores."""
        units = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
        n, width = len(queries), self.nearest + SPARE
        best = np.full((n, width), -np.inf)
        rows = np.full((n, width), -1)
        state = (query_ids, units, best, rows)
        every = np.arange(n)
        self._descend(self.root, every, state)
        self._visit(self.root, every, state, factor)
        number, place = np.nonzero(rows >= 0)
        row = rows[number, place]
        norms = np.sqrt((queries * queries).sum(axis=1))[number] * self.norms[row]
        scores = (self.vectors[row] * queries[number]).sum(axis=1) / norms
        order = np.lexsort((self.ids[row], -scores, number))
        number, row, scores = number[order], row[order], scores[order]
        rank = np.arange(len(number)) - np.searchsorted(number, number)
        top = rank < self.nearest
        return number[top], self.ids[row[top]], scores[top]

    def _descend(self, node, active, state):
        """Each query's likeliest leaf."""
        if not len(active):
            return
        if len(node) == 2:
            self._leaf(node, active, state)
            return
        vantage, near, (_, near_most), far, (far_least, _) = node
        gap = distance(state[1][active] @ self.units[vantage])
        inside = gap <= (near_most + far_least) / 2
        self._descend(near, active[inside], state)
        self._descend(far, active[~inside], state)

    def _visit(self, node, active, state, factor):
        if not len(active):
            return
        if len(node) == 2:
            self._leaf(node, active, state)
            return
        vantage, *children = node
        gap = distance(state[1][active] @ self.units[vantage])
        for child, (least, most) in zip(children[::2], children[1::2], strict=True):
            to_beat = distance(state[2][active, self.nearest - 1])
            bound = np.maximum(least - gap, gap - most)
            self._visit(child, active[factor * bound <= to_beat + SLACK], state, factor)

    def _leaf(self, leaf, active, state):
        """Take up the leaf's rows where they are nearer than what a query has so far."""
        query_ids, units, best, rows = state
        members = self.order[leaf[0] : leaf[1]]
        cosines = units[active] @ self.units[members].T
        cosines[self.ids[members] == query_ids[active, None]] = -np.inf
        better = np.flatnonzero((cosines >= best[active, -1:] - SLACK).any(axis=1))
        if not len(better):
            return
        active = active[better]
        seen = (rows[active, :, None] == members).any(axis=1)
        cosines = np.where(seen, -np.inf, cosines[better])
        scores = np.concatenate([best[active], cosines], axis=1)
        places = np.concatenate([rows[active], np.broadcast_to(members, cosines.shape)], axis=1)
        order = np.lexsort((self.ids[places], -np.round(scores, 11)), axis=1)[:, : best.shape[1]]
        scores, places = np.take_along_axis(scores, order, 1), np.take_along_axis(places, order, 1)
        best[active], rows[active] = scores, np.where(np.isfinite(scores), places, -1)


def _run_sum(repeated, new):
    """For each row, how many repeated rows of its run come before it."""
    total = np.cumsum(repeated) - repeated
    return total - total[np.flatnonzero(new)[np.cumsum(new) - 1]]


def distance(cosines):
    """Between unit vectors, a metric; of what has no cosine yet, infinite."""
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


def usable(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector as doubles, dim) of the rows that take part."""
    rows = only(table, **{vec_id: "bigint", vector: "array<double>"}).toDF("vec_id", "vector")
    limit = F.lit(float("inf"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    apart = F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(finite & apart)
    return rows.withColumn("dim", F.size("vector"))


def nearest(
    table: DataFrame,
    is_query,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = NEAREST,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of `table` to its rows under `is_query`.

    `is_query` is a condition on the column `vec_id`.
    """
    rows = usable(table, vec_id, vector)
    shards = max(1, -(-rows.count() // shard_rows))
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard")
    base = rows.select("dim", shard, F.lit(False).alias("query"), "vec_id", "vector")
    asked = rows.where(is_query).select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), "vec_id", "vector")
    together = base.union(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "query")

    def searched(batches):
        key, held, tree = None, [], None
        for batch in batches:
            dims, numbers, flags = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
            if not len(dims):
                continue
            turns = np.flatnonzero((dims[1:] != dims[:-1]) | (numbers[1:] != numbers[:-1]) | (flags[1:] != flags[:-1])) + 1
            for start, end in zip([0, *turns.tolist()], [*turns.tolist(), len(dims)], strict=True):
                if key != (dims[start], numbers[start]):
                    key, held, tree = (dims[start], numbers[start]), [], None
                part = batch.slice(start, end - start)
                ids = part.column(3).to_numpy()
                vectors = part.column(4).flatten().to_numpy().reshape(len(ids), -1)
                if not flags[start]:
                    held.append((ids, vectors))
                    continue
                if tree is None and held:
                    tree = VantageTree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k)
                    held = []
                if tree is not None:
                    number, found, scores = tree.search(ids, vectors, factor)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[number]), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"]
                    )

    found = together.mapInArrow(searched, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
