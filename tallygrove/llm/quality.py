"""Quality: labelled neighbours vote in a latent-semantic space.

A text's terms are the trigrams of its byte classes (lower case, upper case, digit, blank, line
end, beyond ASCII, and each mark by itself), hashed, and words that follow themselves, as one
term for each step of their share that a text reaches. Terms are weighted log(1 + count) * idf and projected on the leading singular vectors of
the labelled sample. Each document's vector is compared with all labelled vectors by exact
cosines, a block of documents at a time; the `NEIGHBOURS` nearest vote for their label with
weight cosine ** `SHARPNESS`.

Null and empty texts have no terms, and with no cosine above zero the score is the share of
label 1 in the sample. Texts of any length count whole. Equal cosines are taken in the order of
the sample. Repeated rows get equal scores, an empty table gives an empty result. Without a
labelled row of each class every score is the share of label 1 with one row more of each, 0.5 for none.
"""

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallygrove.llm.common import extended, numbered, utf8

TERMS = 2048
REPEATS = 16  # of these, for steps of the share of words that follow themselves
DIMENSIONS = 48
NEIGHBOURS = 20
SHARPNESS = 4
TRAIN_ROWS_PER_CLASS = 2500  # the bound of the labelled sample
BLOCK = 256  # documents compared at once
PIECE = 1 << 22  # bytes of a text counted at once

CLASSES = np.array(
    [
        0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b == 10 else 4 if b <= 32
        else 5 if b >= 128 else b - 27 if b <= 47 else b - 37 if b <= 64 else b - 63 if b <= 96 else b - 89
        for b in range(256)
    ],
    np.uint32,
)
N_CLASSES = np.uint32(int(CLASSES.max()) + 1)


@dataclass(frozen=True)
class QualityModel:
    """`projection` takes weighted counts to the latent space; rows of `vectors` have unit length."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def term_counts(text: bytes) -> np.ndarray:
    counts = np.zeros(TERMS)
    grams_end = TERMS - REPEATS
    data = np.frombuffer(text, np.uint8)
    for start in range(0, max(0, len(data) - 2), PIECE):
        kinds = CLASSES[data[start : start + PIECE + 2]]
        grams = (kinds[:-2] * N_CLASSES + kinds[1:-1]) * N_CLASSES + kinds[2:]
        numbers = (grams * np.uint32(2654435769)) >> np.uint32(32 - TERMS.bit_length() + 1)
        counts += np.bincount(np.minimum(numbers, grams_end - 1), minlength=TERMS)
    words = text.split()
    again = sum(map(eq, words, words[1:]))
    counts[grams_end : grams_end + again * REPEATS // max(1, len(words) - 1)] = again
    return counts


def weighted(texts: list, idf: np.ndarray) -> np.ndarray:
    counts = np.log1p(np.array([term_counts(t) for t in texts]).reshape(len(texts), TERMS))
    return unit((counts * idf).astype(np.float32))


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def fit(training: DataFrame) -> QualityModel:
    """Learn from (text, label). The caller bounds the rows, as `drawn_rows` does."""

    def counted(batches):
        for batch in batches:
            counts = np.array([term_counts(t) for t in utf8(batch.column(0))], np.float32).reshape(-1, TERMS)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(counts.ravel()), TERMS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], ["label", "counts"])

    rows = training.select("text", "label").mapInArrow(counted, "label int, counts array<float>").toArrow()
    labels = rows["label"].to_numpy().astype(np.float32)
    if not 0 < labels.sum() < len(labels):
        # One class, or none, tells nothing: a vector that no text is near to, and the smoothed share.
        share = np.array([(labels.sum() + 1) / (len(labels) + 2)], np.float32)
        none = np.zeros((TERMS, DIMENSIONS), np.float32)
        return QualityModel(np.ones(TERMS), none, none[:1], share)
    counts = np.concatenate([c.flatten().to_numpy() for c in rows["counts"].chunks]).reshape(-1, TERMS)
    # The order in which tasks answer must not matter.
    order = np.lexsort((labels, *counts.T[:8], counts @ np.arange(1, TERMS + 1, dtype=np.float64)))
    counts, labels = counts[order], labels[order]
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.1
    terms = unit((np.log1p(counts) * idf).astype(np.float32))
    _, axes = np.linalg.eigh((terms.T @ terms).astype(np.float64))
    projection = axes[:, ::-1][:, :DIMENSIONS].astype(np.float32)
    return QualityModel(idf, projection, unit(terms @ projection), labels)


def votes(vectors: np.ndarray, model: QualityModel) -> np.ndarray:
    """Scores of latent vectors, by all cosines with the labelled ones."""
    cosines = vectors @ model.vectors.T
    k = min(NEIGHBOURS, cosines.shape[1])
    nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weights = np.maximum(np.take_along_axis(cosines, nearest, 1), 0).astype(np.float64) ** SHARPNESS
    total = weights.sum(axis=1)
    share = (weights * model.labels[nearest]).sum(axis=1) / np.where(total > 0, total, 1)
    return np.clip(np.where(total > 0, share, model.labels.mean()), 0, 1)


def score(documents: DataFrame, model: QualityModel, text: str = "text", out: str = "quality") -> DataFrame:
    """The rows of `documents`, all columns kept, with a score from 0 to 1 in `out`.

    A column named like `out` is replaced. No shuffle; what is broadcast is bounded by the sample.
    """
    fields = (model.idf, model.projection, model.vectors, model.labels)
    sent = documents.sparkSession.sparkContext.broadcast(fields)
    kept = documents.drop(out)
    place = kept.columns.index(text)
    rows = numbered(kept)

    def scored(batches):
        model = QualityModel(*sent.value)
        for batch in batches:
            texts = utf8(batch.column(place))
            blocks = [texts[k : k + BLOCK] for k in range(0, len(texts), BLOCK)]
            found = [votes(unit(weighted(b, model.idf) @ model.projection), model) for b in blocks]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"]
            )

    return rows.mapInArrow(scored, extended(rows, score="double")).toDF(*kept.columns, out)
