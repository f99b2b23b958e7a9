"""Toxicity: a character n-gram linear classifier on features scaled by log-count ratios.

A text's features are the distinct hashed n-grams of its bytes, A-Z lower-cased. Each is scaled
by its naive Bayes log-count ratio, log(share in class 1 / share in class 0); a logistic
regression on the scaled features gives the weights. In scoring both fold into one weight per
n-gram, so a score is one pass over the bytes of the whole text.

Null and empty texts have no n-grams and get the score of the intercept. Any length is scored
whole, in blocks. Repeated rows get equal scores, an empty table gives an empty result. Without
a labelled row of each class every score is the share of label 1 with one row more of each, 0.5 for
none.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import extended, numbered, packed
from tallygrove.session import materialise

LENGTHS = (4, 5, 6)
BUCKETS_LOG2 = 20
TRAIN_ROWS_PER_CLASS = 5000  # the bound of the sample that the classifier is fitted on
LEAST_ROWS = 6  # an n-gram in fewer training rows is no feature
LEAST_RATIO = 1.0  # nor is one with a log-count ratio nearer to zero
SMOOTHING = 1.0
BLOCK = 1 << 19  # bytes hashed at once

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass(frozen=True)
class ToxicityModel:
    """`weights[h]`: what the presence of n-gram bucket h adds to the log odds."""

    weights: np.ndarray
    intercept: float


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each position."""
    value = np.full(len(data) - n + 1, 2166136261 + n, np.uint32)
    for k in range(n):
        value = (value ^ data[k : len(data) - n + 1 + k]) * np.uint32(16777619)
    value ^= value >> np.uint32(15)
    return (value * np.uint32(2654435769)) >> np.uint32(32 - BUCKETS_LOG2)


def present(data: np.ndarray, offsets: np.ndarray, chosen):
    """Parts of (text number, bucket), distinct and sorted, for the n-grams inside each text.

    `chosen`: a boolean per bucket, or None for all. A part is of texts of `BLOCK` bytes together,
    or of one longer text, which is hashed a block at a time; so memory is bounded by a block and
    by the buckets there are.
    """
    text = 0
    while text < len(offsets) - 1:
        end = max(text + 1, int(np.searchsorted(offsets, offsets[text] + BLOCK, side="right")) - 1)
        found = np.zeros(0, np.int64)
        for start in range(offsets[text], offsets[end], BLOCK):
            stop = min(offsets[end], start + BLOCK + max(LENGTHS) - 1)
            found = np.union1d(found, _in_block(data[start:stop], start, offsets[: end + 1], chosen))
        yield found >> BUCKETS_LOG2, found & ((1 << BUCKETS_LOG2) - 1)
        text = end


def _in_block(data, start, offsets, chosen):
    """Text number and bucket, as one number, of the n-grams that begin in a block."""
    block, pairs = LOWER[data], []
    for n in (n for n in LENGTHS if n <= len(block)):
        buckets = gram_hashes(block, n)[:BLOCK]
        at = np.arange(len(buckets)) if chosen is None else np.flatnonzero(chosen[buckets])
        text = np.searchsorted(offsets, at + start, side="right") - 1
        inside = at + start + n <= offsets[text + 1]
        pairs.append((text[inside] << BUCKETS_LOG2) | buckets[at[inside]])
    return np.concatenate(pairs) if pairs else np.zeros(0, np.int64)


def fit(training: DataFrame) -> ToxicityModel:
    """Learn from (text, label). The caller bounds the rows, as `drawn_rows` does.

    Counts of n-grams are summed by Spark; the driver sees one row per bucket that passes, and
    the chosen buckets of each training row.
    """
    training = materialise(training.select("text", "label"))
    totals = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        # One class, or none, tells nothing: the share of label 1 with one row more of each.
        odds = (totals.get(1, 0) + 1) / (totals.get(0, 0) + 1)
        return ToxicityModel(np.zeros(1 << BUCKETS_LOG2, np.float32), float(np.log(odds)))

    def counted(batches):
        sums = np.zeros((2, 1 << BUCKETS_LOG2), np.int32)
        for batch in batches:
            data, offsets = packed(batch.column(0))
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for text, bucket in present(data, offsets, None):
                for value in (0, 1):
                    np.add.at(sums[value], bucket[labels[text] == value], 1)
        bucket = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int32()), pa.array(sums[0][bucket]), pa.array(sums[1][bucket])],
            ["bucket", "n0", "n1"],
        )

    rows = [
        (F.col(f"n{value}") + F.lit(SMOOTHING)) / F.lit(totals[value] + 2 * SMOOTHING) for value in (0, 1)
    ]
    counts = (
        training.mapInArrow(counted, "bucket int, n0 int, n1 int")
        .groupBy("bucket")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where(F.col("n0") + F.col("n1") >= LEAST_ROWS)
        .select("bucket", F.log(rows[1] / rows[0]).alias("ratio"))
        .where(F.abs("ratio") >= LEAST_RATIO)
        .toArrow()
    )
    ratios = np.zeros(1 << BUCKETS_LOG2, np.float32)
    ratios[counts["bucket"].to_numpy()] = counts["ratio"].to_numpy()

    def features(batches):
        chosen = ratios != 0
        for batch in batches:
            parts = list(present(*packed(batch.column(0)), chosen))
            text, bucket = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1)], ["buckets", "label"])

    table = training.mapInArrow(features, "buckets array<int>, label int").toArrow().combine_chunks()
    lists = table["buckets"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    bucket = lists.flatten().to_numpy()
    weights, intercept = logistic(row, bucket, ratios, table["label"].to_numpy().astype(np.float32))
    return ToxicityModel(weights, intercept)


def logistic(row, bucket, scale, labels, steps=300, penalty=1e-3) -> tuple:
    """Weights per bucket, scales folded in, by gradient steps of Adam on the mean log loss."""
    used, column = np.unique(bucket, return_inverse=True)
    values = scale[used][column]
    weights, n = np.zeros(len(used) + 1), len(labels)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        margin = np.bincount(row, values * weights[column], n) + weights[-1]
        wrong = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels
        slope = np.append(np.bincount(column, values * wrong[row], len(used)), wrong.sum()) / n
        slope[:-1] += penalty * weights[:-1]
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        weights -= 0.02 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    dense = np.zeros(len(scale), np.float32)
    dense[used] = weights[:-1] * scale[used]
    return dense, float(weights[-1])


def score(documents: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """The rows of `documents`, all columns kept, with a score from 0 to 1 in `out`.

    A column named like `out` is replaced. No shuffle; the model, bounded by its number of
    buckets, is the only thing that is sent.
    """
    weights = documents.sparkSession.sparkContext.broadcast(model.weights)
    intercept = model.intercept
    kept = documents.drop(out)
    place = kept.columns.index(text)
    rows = numbered(kept)

    def scored(batches):
        weight = weights.value
        chosen = weight != 0
        for batch in batches:
            margin = np.full(batch.num_rows, intercept)
            for row, bucket in present(*packed(batch.column(place)), chosen):
                margin += np.bincount(row, weight[bucket], batch.num_rows)
            scores = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"]
            )

    return rows.mapInArrow(scored, extended(rows, score="double")).toDF(*kept.columns, out)
