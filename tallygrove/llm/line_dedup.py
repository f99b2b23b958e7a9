"""Line dedup: two Bloom filters find suspected repeats, an exact count confirms them.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased. Pass 1
fills two Bloom filters of a fixed size in each task: keys seen in a document, and keys seen in a
second one. They are merged in pieces: a key is in the merged second filter if it is in one of
the second filters, or in two of the first ones. Pass 2 counts only keys that the merged second
filter holds, pre-aggregated in each task, by a 128-bit cryptographic digest; so a false positive
of a filter costs a row in the shuffle and never a line. Pass 3 drops lines.

A full filter suspects every key; results stay the same, more rows are counted.

Null and empty texts are one empty line; blank lines have no key and always stay. Each row is a
document of its own when documents are counted, repeated rows too. Rows of an equal `doc_id` tie
for the first occurrence: it is kept in each of them. A null `doc_id` comes last. An empty table
gives an empty result.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import extended, numbered, utf8
from tallygrove.session import materialise

FILTER_BITS_LOG2 = 26  # 8 MB a filter, whatever the input
HASHES = 4
PIECES = 32  # in which filters are merged
BROADCAST_KEYS = 300_000  # more confirmed keys than this reach their documents by a join
HELD_KEYS = 200_000  # counted keys a task holds before it passes them on


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def digests(text: bytes, min_chars: int) -> list:
    """A digest for each line, None where the key is too short to count."""
    found = []
    for line in text.split(b"\n"):
        key = line_key(line)
        short = len(key) < min_chars or min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars
        found.append(None if short else hashlib.blake2b(key, digest_size=16).digest())
    return found


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of digests, given as rows of two 64-bit numbers; one row for each hash."""
    steps = np.arange(HASHES, dtype=np.uint64)[:, None]
    return (keys[:, 0] + steps * (keys[:, 1] | np.uint64(1))) & np.uint64((1 << bits) - 1)


def as_numbers(keys: list) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def put(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at.ravel() >> np.uint64(3), np.uint8(1) << (at.ravel() & np.uint64(7)).astype(np.uint8))


def holds(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    bit = bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)
    return (bit & 1).all(axis=0)


def twice_seen(documents: DataFrame, text: str, min_chars: int, bits: int) -> np.ndarray:
    """The merged filter of keys seen in two documents or more."""
    part = F.spark_partition_id().alias("part")

    def filled(batches):
        once, twice = (np.zeros(1 << (bits - 3), np.uint8) for _ in range(2))
        task = 0
        for batch in batches:
            task = batch.column(1)[0].as_py() if batch.num_rows else task
            keys = [k for x in utf8(batch.column(0)) for k in {d for d in digests(x, min_chars) if d}]
            if not keys:
                continue
            unique, counts = np.unique(np.array(keys, "V16"), return_counts=True)
            at = positions(unique.view("<u8").reshape(-1, 2), bits)
            put(twice, at[:, (counts > 1) | holds(once, at)])
            put(once, at)
        size = len(once) // PIECES
        for piece in range(PIECES):
            window = slice(piece * size, (piece + 1) * size)
            if once[window].any():
                yield pieces([piece], [task], [once[window]], [twice[window]])

    def pieces(piece, task, once, twice):
        squeezed = [pa.array([zlib.compress(x.tobytes(), 1) for x in xs], pa.binary()) for xs in (once, twice)]
        return pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int32()), pa.array(task, pa.int32()), *squeezed], ["piece", "part", "once", "twice"]
        )

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = None
        for batch in batches:
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if once is None:
                    once, twice = a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        yield pieces([key[0].as_py()], [0], [once], [twice])

    schema = "piece int, part int, once binary, twice binary"
    filters = documents.select(F.col(f"`{text}`").cast("string"), part).mapInArrow(filled, schema)
    # In two steps, so that no group holds the filters of more than 64 tasks at once.
    group = F.floor(F.col("part") / 64)
    step = filters.withColumn("part", group.cast("int")).groupBy("piece", "part").applyInArrow(merged, schema)
    whole = np.zeros(1 << (bits - 3), np.uint8)
    size = len(whole) // PIECES
    for row in step.groupBy("piece").applyInArrow(merged, schema).select("piece", "twice").toLocalIterator():
        whole[row["piece"] * size : (row["piece"] + 1) * size] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return whole


def repeated_keys(documents: DataFrame, doc_id: str, text: str, min_docs: int, min_chars: int, bits: int) -> DataFrame:
    """(digest, n, first): keys found in `min_docs` documents or more, and their first document."""
    spark = documents.sparkSession
    suspects = spark.sparkContext.broadcast(twice_seen(documents, text, min_chars, bits)) if min_docs > 1 else None

    def counted(batches):
        bitmap = suspects.value if suspects else None
        held = {}

        def passed_on():
            ids = [n[1] for n in held.values()]
            return pa.RecordBatch.from_arrays(
                [pa.array(held, pa.binary()), pa.array([n[0] for n in held.values()], pa.int64()), pa.array(ids, pa.int64())],
                ["digest", "n", "first"],
            )

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                keys = [d for d in dict.fromkeys(digests(data, min_chars)) if d]
                if bitmap is not None and keys:
                    known = holds(bitmap, positions(as_numbers(keys), bits))
                    keys = [k for k, yes in zip(keys, known, strict=True) if yes]
                for key in keys:
                    n, first = held.get(key, (0, None))
                    held[key] = (n + 1, doc if first is None else first if doc is None else min(first, doc))
            if len(held) >= HELD_KEYS:
                yield passed_on()
                held = {}
        if held:
            yield passed_on()

    ids = documents.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`").cast("string"))
    return (
        ids.mapInArrow(counted, "digest binary, n bigint, first bigint")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        .where(F.col("n") >= min_docs)
    )


def keys_by_row(rows: DataFrame, repeated: DataFrame, min_chars: int) -> DataFrame:
    """(_row, _keys): the repeated keys of each of the (_row, text) rows, so no more than its lines."""

    def occurrences(batches):
        for batch in batches:
            pairs = [
                (row, key)
                for row, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True)
                for key in {d for d in digests(data, min_chars) if d}
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())],
                ["_row", "digest"],
            )

    texts = rows.select(F.col("_row"), F.col(rows.columns[1]).cast("string"))
    held = texts.mapInArrow(occurrences, "_row bigint, digest binary").join(repeated.select("digest", "first"), "digest")
    return held.groupBy("_row").agg(F.collect_list(F.struct("digest", "first")).alias("_keys"))


def dedup_lines(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = 2,
    min_chars: int = 1,
    keep_first: bool = True,
    bits: int = FILTER_BITS_LOG2,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """All columns of `documents`, `text` without its repeated lines, `n_lines`, `n_dropped`.

    A key of at least `min_chars` code points found in at least `min_docs` documents is
    repeated. Its lines go from every document; with `keep_first`, the first line of the document
    with the smallest id stays. Columns named `n_lines` or `n_dropped` are replaced.

    Confirmed keys are broadcast within `broadcast_keys`; beyond it the rows are written once with
    a number each and keys are joined to the rows that hold them, with equal results.
    """
    documents = documents.drop("n_lines", "n_dropped")
    named = [*documents.columns, "n_lines", "n_dropped"]
    doc_id, text = (f"c{documents.columns.index(name)}" for name in (doc_id, text))
    documents = numbered(documents)
    repeated = materialise(repeated_keys(documents, doc_id, text, min_docs, min_chars, bits))
    names = documents.columns
    id_at, text_at = names.index(doc_id), names.index(text)
    schema = extended(documents, n_lines="bigint", n_dropped="bigint")

    def stripped(batch, names, first_of):
        texts, lines, dropped = [], [], []
        ids = batch.column(id_at).cast(pa.int64()).to_pylist()
        for row, data in enumerate(utf8(batch.column(text_at))):
            known, kept, seen = first_of(row), [], set()
            parts = data.split(b"\n")
            keys = digests(data, min_chars) if known else [None] * len(parts)
            for line, key in zip(parts, keys, strict=True):
                if key in known if key else False:
                    if not keep_first or known[key] != ids[row] or key in seen:
                        continue
                    seen.add(key)
                kept.append(line)
            texts.append(b"\n".join(kept))
            lines.append(len(parts))
            dropped.append(len(parts) - len(kept))
        columns = list(batch.columns[: len(names)])
        columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
        columns += [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped"])

    if repeated.limit(broadcast_keys + 1).count() <= broadcast_keys:
        table = repeated.select("digest", "first").toArrow()
        known = dict(zip(table["digest"].to_pylist(), table["first"].to_pylist(), strict=True))
        sent = documents.sparkSession.sparkContext.broadcast(known)

        def by_broadcast(batches):
            known = sent.value
            for batch in batches:
                yield stripped(batch, names, lambda row: known)

        return documents.mapInArrow(by_broadcast, schema).toDF(*named)

    rows = materialise(documents.withColumn("_row", F.monotonically_increasing_id()))
    joined = rows.join(keys_by_row(rows.select("_row", text), repeated, min_chars), "_row", "left")

    def by_join(batches):
        for batch in batches:
            keys = batch.column(len(names)).to_pylist()
            yield stripped(batch, names, lambda row: {k["digest"]: k["first"] for k in keys[row] or ()})

    return joined.select(*names, "_keys").mapInArrow(by_join, schema).toDF(*named)
