"""Document fingerprints by a homomorphic multiset hash.

Each paragraph is hashed to a wide vector, and a text's fingerprint is the sum of the vectors of
its paragraphs, coordinate by coordinate, modulo a power of two. So the order of paragraphs does
not matter, a paragraph is added or taken away without the rest of the text, and fingerprints of
parts add up to that of the whole.

The vector has two parts:
* `EXACT` coordinates modulo 2 ** 64, a cryptographic digest of the paragraph. Equal multisets of
  paragraphs have equal sums; others differ but for chance (not against someone who seeks a clash).
* `LIKENESS` coordinates modulo 2 ** 32: for every different run of `RUN` bytes of the paragraph +1
  or -1 at a place, both given by a hash. The squared length of the difference of two sums then estimates,
  without bias, that of the difference of their counts of runs (once a paragraph), and so `likeness` needs nothing
  but the two fingerprints: 1 for equal ones, else 2ab / (aa + bb), at least 0, which is near the
  share of runs in common for texts of like lengths. Its error is about 0.06.

A paragraph is what stands between line feeds, empty ones included, so a text without any is one
paragraph. Null counts as the empty text. A fingerprint is a string, base64 of both parts, least
byte first, with zeros at the end of the second part left out.
"""

import base64
import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.llm.common import extended, numbered, only, utf8
from tallygrove.session import materialise

EXACT = 8
LIKENESS = 256
RUN = 16
BLOCK = 1 << 18  # bytes of a text whose runs are hashed at once
PART_BYTES = 32 << 20  # of texts in a part of the order of ids
SAMPLES = 100  # keys for each part, from which its bounds are drawn

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)  # the first k bytes


class Fingerprint:
    """A sum of paragraph vectors."""

    def __init__(self, exact=None, counts=None):
        self.exact = np.zeros(EXACT, np.uint64) if exact is None else exact
        self.counts = np.zeros(LIKENESS, np.uint32) if counts is None else counts

    @classmethod
    def of(cls, text: bytes) -> "Fingerprint":
        digests = b"".join(hashlib.blake2b(p).digest() for p in text.split(b"\n"))
        exact = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)
        return cls(exact, run_counts(text))

    def __add__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.exact + other.exact, self.counts + other.counts)

    def __sub__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.exact - other.exact, self.counts - other.counts)

    def __eq__(self, other) -> bool:
        return bool((self.exact == other.exact).all() and (self.counts == other.counts).all())

    def __str__(self) -> str:
        counts = self.counts.astype("<u4").tobytes().rstrip(b"\0")
        return base64.b64encode(self.exact.astype("<u8").tobytes() + counts).decode()

    @classmethod
    def parse(cls, text: str) -> "Fingerprint":
        data = base64.b64decode(text)
        counts = data[EXACT * 8 :].ljust(LIKENESS * 4, b"\0")
        return cls(np.frombuffer(data[: EXACT * 8], "<u8"), np.frombuffer(counts, "<u4"))


def run_counts(text: bytes) -> np.ndarray:
    """The signed counts of the hashed runs of each paragraph; a short paragraph is one run.

    A run counts once in each `BLOCK` bytes of its paragraph, so that a repeated word or line does
    not outweigh the rest.
    """
    counts = np.zeros(LIKENESS, np.int64)
    size = len(text)
    data = np.frombuffer(text + b"\0" * (2 * RUN), np.uint8)
    breaks = np.flatnonzero(data[:size] == 10)
    starts, ends = np.append(0, breaks + 1), np.append(breaks, size)
    long = np.flatnonzero(ends - starts >= RUN)
    # Blocks of a paragraph count from its own beginning, wherever it stands.
    lows, highs = starts[long], ends[long] - RUN + 1
    if size > BLOCK:
        cuts = [np.arange(a, b, BLOCK) for a, b in zip(lows.tolist(), highs.tolist(), strict=True)]
        highs = np.minimum(np.concatenate([*cuts, lows[:0]]) + BLOCK, np.repeat(highs, [len(c) for c in cuts]))
        lows = np.concatenate([*cuts, lows[:0]])
    for some in _lots(highs - lows):
        sizes = (highs - lows)[some]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.repeat(lows[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        mixed = _mixed(*_words(data, at))
        _, once = np.unique(mixed + owner.astype(np.uint64) * _MIX[1], return_index=True)
        counts += _placed(mixed[once])
    short = (ends - starts < RUN) & (ends > starts)
    if short.any():
        first, second = _words(data, starts[short])
        left = (ends - starts)[short]
        counts += _placed(_mixed(first & _LOW[np.minimum(left, 8)], second & _LOW[np.clip(left - 8, 0, 8)]))
    return counts.astype(np.uint32)


def _lots(sizes):
    """Slices of neighbours that together hold about BLOCK."""
    if not len(sizes):
        return
    lot = (np.cumsum(sizes) - 1) // BLOCK
    edges = np.flatnonzero(np.diff(lot, prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(sizes)], strict=True):
        yield slice(a, b)


def _words(data, at):
    """The RUN bytes from each place on, as two numbers."""
    every = np.lib.stride_tricks.sliding_window_view(data, 8)
    return (np.ascontiguousarray(every[at + k]).view("<u8").reshape(-1) for k in (0, 8))


def _mixed(first, second):
    mixed = first * _MIX[0] ^ (second * _MIX[1] + (first >> np.uint64(29)))
    return (mixed ^ mixed >> np.uint64(32)) * _MIX[2]


def _placed(mixed):
    sign = (mixed >> np.uint64(62) & np.uint64(1)).astype(np.int64) * 2 - 1
    return np.bincount((mixed >> np.uint64(40)).astype(np.int64) % LIKENESS, sign, LIKENESS).astype(np.int64)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """From 0 to 1; 1 for equal fingerprints and for no others."""
    if a == b:
        return 1.0
    # Counts are numbers from -2 ** 31 on.
    x, y = (f.counts.astype(np.uint32).view(np.int32).astype(np.float64) for f in (a, b))
    both = (x @ x) + (y @ y)
    return float(np.clip(2 * (x @ y) / both, 0.0, np.nextafter(1.0, 0.0))) if both else 0.0


def with_fingerprints(documents: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `documents` and `fingerprint`. No shuffle."""
    documents = documents.drop("fingerprint")
    place, rows = documents.columns.index(text), numbered(documents)
    schema = extended(rows, fingerprint="string")

    def marked(batches):
        for batch in batches:
            found = [str(Fingerprint.of(x)) for x in utf8(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], schema.names)

    return rows.mapInArrow(marked, schema).toDF(*documents.columns, "fingerprint")


@F.arrow_udf(T.StringType())
def _changed(fingerprint: pa.Array, inserted: pa.Array, deleted: pa.Array) -> pa.Array:
    out = []
    for known, more, less in zip(*(c.to_pylist() for c in (fingerprint, inserted, deleted)), strict=True):
        total = Fingerprint.parse(known) if known else Fingerprint()
        for paragraph in more or ():
            total = total + Fingerprint.of((paragraph or "").encode())
        for paragraph in less or ():
            total = total - Fingerprint.of((paragraph or "").encode())
        out.append(str(total))
    return pa.array(out, pa.string())


def changed(fingerprint, inserted, deleted):
    """A column: the fingerprint after texts of an array are added and others taken away."""
    return _changed(fingerprint, inserted, deleted)


def characters(text: bytes) -> np.ndarray:
    """Where each code point begins."""
    return np.flatnonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)


class Edit:
    """A text whose last quarter is replaced by the beginning of another one."""

    def __init__(self, text: bytes, known: Fingerprint, other: bytes):
        begins = characters(text)
        self.n_chars, count = len(begins), len(begins) // 4
        cut = int(begins[self.n_chars - count]) if count else len(text)
        # Not more bytes are looked at than so many code points can take.
        begins = characters(other[: 4 * count + 4])
        taken = other[: int(begins[count])] if count < len(begins) else other[: 4 * count + 4] if count else b""
        self.text = text[:cut] + taken
        # Paragraphs before the one that is cut stay as they are.
        start = text.rfind(b"\n", 0, cut) + 1
        self.fingerprint = known - Fingerprint.of(text[start:]) + Fingerprint.of(self.text[start:])


def compare_edits(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of an edited text and that of the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The
    last n_chars / 4 code points are replaced by the first of the next document. The edited text's
    fingerprint is the old one with the paragraphs from the cut on taken away and the new ones added.

    Documents are in order of id, null last, then of a hash of the text; the last is followed by the
    first, a single one by itself. An order of all rows needs no row in one task: parts of it, cut at
    quantiles of (id, hash) pairs, are one shuffle of the texts; a copy of the first document of a
    part closes the part before. Only the pairs are written before, and no more than a pair or a
    text for a part and `SAMPLES` pairs for a part's bounds come to the driver or are broadcast.
    """
    spark = documents.sparkSession
    docs = only(documents, **{doc_id: "bigint", text: "string"}).toDF("doc_id", "text")
    docs = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    keys = materialise(docs.select("doc_id", "tie", F.octet_length("text").alias("bytes")))
    total = keys.agg(F.count("*"), F.sum("bytes")).first()
    parts = max(spark.sparkContext.defaultParallelism, (total[1] or 0) // PART_BYTES)
    drawn = keys.where(F.pmod(F.xxhash64("tie", "doc_id"), F.lit(max(1, total[0] // (parts * SAMPLES)))) == 0)
    drawn = drawn.select("doc_id", "tie").distinct().orderBy(F.asc_nulls_last("doc_id"), "tie")
    sample = [(d is None, d or 0, tie) for d, tie in drawn.toLocalIterator()]
    bounds = sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []
    sent = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf(T.IntegerType())
    def part_of(ids: pa.Array, ties: pa.Array) -> pa.Array:
        rows = zip(ids.to_pylist(), ties.to_pylist(), strict=True)
        return pa.array([bisect_right(sent.value, (d is None, d or 0, tie)) for d, tie in rows], pa.int32())

    part = part_of("doc_id", "tie")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    firsts = keys.select(part.alias("part"), order.alias("first")).groupBy("part").agg(F.min("first").alias("first"))
    firsts = sorted((row["part"], row["first"]["doc_id"], row["first"]["tie"]) for row in firsts.collect())
    closing = [(here[0], *after[1:]) for here, after in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    closing = spark.createDataFrame(closing, "part int, _id bigint, _tie bigint")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))
    copies = docs.join(F.broadcast(closing), same).groupBy("part", "doc_id", "tie").agg(F.min("text").alias("text"))

    rows = docs.select(part.alias("part"), F.lit(False).alias("copy"), "doc_id", "tie", "text")
    rows = rows.unionByName(copies.withColumn("copy", F.lit(True)))
    rows = rows.repartition("part").sortWithinPartitions("part", "copy", F.asc_nulls_last("doc_id"), "tie")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]

    def compared(batches):
        before = None
        for batch in batches:
            out = []
            for copy, doc, data in zip(*(batch.column(k).to_pylist() for k in (0, 1)), utf8(batch.column(2)), strict=True):
                mark = Fingerprint.of(data)
                if before:
                    doc_before, text_before, mark_before = before
                    edit = Edit(text_before, mark_before, data)
                    near = likeness(mark_before, edit.fingerprint), likeness(mark_before, mark)
                    digest = hashlib.sha256(edit.text).hexdigest()
                    out.append((doc_before, edit.n_chars, digest, str(mark_before), str(edit.fingerprint), *near))
                before = None if copy else (doc, data, mark)
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string"
    return rows.select("copy", "doc_id", "text").mapInArrow(compared, f"{schema}, near_edited double, near_next double")
