"""Byte-pair token counts over a vocabulary table (token binary, rank int)."""

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.functions.pieces import SPECIAL_TOKENS, pieces
from tallygrove.session import materialise

# A vocabulary within both bounds is broadcast; a larger one is joined.
BROADCAST_ENTRIES = 1_000_000
BROADCAST_BYTES = 64 << 20

MEMO = 1_000_000  # distinct pieces a worker process remembers
MEMO_PIECE = 256  # bytes of the longest piece it remembers, so that all take 256 MB at most
LOT_BYTES = 32 << 20  # of text that shares its part of a vocabulary that is joined
FILTER_BITS = 1 << 26  # of the bitmap of a vocabulary that is joined


def read_vocab(spark: SparkSession, location: str) -> DataFrame:
    """A text file of `base64 rank` lines."""
    parts = F.split("value", " ")
    return spark.read.text(location).where("value <> ''").select(
        F.unbase64(parts[0]).alias("token"), parts[1].cast("int").alias("rank")
    )


def merged_parts(piece: bytes, ranks: dict) -> int:
    """Parts left once the adjacent pair of lowest rank (leftmost on ties) has been merged
    until no pair is in the vocabulary. O(n log n), since a piece may be very long."""
    size = len(piece)
    end = list(range(1, size + 1))
    before = list(range(-1, size))
    queue = [
        (ranks[piece[i : i + 2]], i, i + 1, i + 2)
        for i in range(size - 1)
        if piece[i : i + 2] in ranks
    ]
    heapify(queue)
    parts = size
    while queue:
        _, start, middle, stop = heappop(queue)
        if end[start] != middle or end[middle] != stop:
            continue  # one of the two has been merged since
        end[start], end[middle] = stop, 0
        parts -= 1
        if stop < size:
            before[stop] = start
            pair = piece[start : end[stop]]
            if pair in ranks:
                heappush(queue, (ranks[pair], start, stop, end[stop]))
        left = before[start]
        if left >= 0:
            pair = piece[left:stop]
            if pair in ranks:
                heappush(queue, (ranks[pair], left, start, stop))
    return parts


def with_bpe_tokens(
    files: DataFrame,
    vocab: DataFrame,
    broadcast_entries: int = BROADCAST_ENTRIES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Adds `tokens` to (content, …)."""
    size = vocab.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()
    if size[0] > broadcast_entries or size[1] > broadcast_bytes:
        return _join_vocab(files, vocab)
    table = vocab.select("token", "rank").toArrow()
    ranks = dict(zip(table["token"].to_pylist(), table["rank"].to_pylist()))
    # The memo lies next to the ranks, so that all tasks of a worker process share it.
    tally = _piece_tally(files.sparkSession.sparkContext.broadcast((ranks, {})))
    return files.withColumn("tokens", tally(pieces(F.col("content"))))


def _piece_tally(shared):
    """array<string> of pieces to its number of tokens.

    Each Arrow batch is dictionary-encoded, so that Python sees a piece once per batch.
    """

    @F.arrow_udf(T.LongType())
    def tally(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks, memo = shared.value
        for batch in batches:
            yield _summed(batch, ranks, memo)

    return tally


def _summed(lists: pa.Array, ranks: dict, memo: dict) -> pa.Array:
    """Tokens of each list of pieces; `memo` holds counts of pieces met before."""
    coded = lists.flatten().dictionary_encode()
    counts = []
    for piece in coded.dictionary.to_pylist():
        count = memo.get(piece)
        if count is None:
            raw = piece.encode()
            count = 1 if raw in ranks or piece in SPECIAL_TOKENS else merged_parts(raw, ranks)
            if len(piece) <= MEMO_PIECE:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[piece] = count
        counts.append(count)
    each = np.array(counts, dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
    sums = np.concatenate([[0], np.cumsum(each)])
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    stops = np.cumsum(lengths, dtype=np.int64)
    return pa.array(sums[stops] - sums[stops - lengths], pa.int64())


def _likely_entries(dealt: DataFrame, vocab: DataFrame, longest: int) -> DataFrame:
    """(_lot, token): runs of two bytes or more of each lot's pieces that may be entries; few come twice.

    Runs are looked up in a bitmap of the entries' hashes, of FILTER_BITS whatever the size of
    the vocabulary, so what leaves the task is what is an entry, and the odd run that only
    looks like one.
    """
    place = F.pmod(F.xxhash64("token"), F.lit(FILTER_BITS)) + 1  # positions count from 1
    bitmaps = (
        vocab.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    )
    size = 32768 // 8  # bytes of a bucket; the first is number 1
    filled = bytearray(FILTER_BITS // 8 + size)
    for row in bitmaps.toLocalIterator():
        start = (row["bucket"] - 1) * size
        filled[start : start + size] = row["bits"].ljust(size, b"\0")
    sent = dealt.sparkSession.sparkContext.broadcast(bytes(filled))

    def found(batches):
        bits, hashed = sent.value, xxhash.xxh64_intdigest
        at, met, seen = None, set(), set()  # pieces and runs of the present lot
        for batch in batches:
            lots, runs = [], []
            starts = np.flatnonzero(np.diff(batch.column(0).to_numpy(), prepend=-1))
            for first, last in zip(starts, [*starts[1:], len(batch)], strict=True):
                lot = batch.column(0)[first].as_py()
                if lot != at:
                    at, met, seen = lot, set(), set()
                for text in batch.column(1)[first:last].flatten().unique().to_pylist():
                    if text in met:
                        continue
                    if len(text) <= MEMO_PIECE:
                        if len(met) >= MEMO:
                            met.clear()
                        met.add(text)
                    piece = text.encode()
                    for start in range(len(piece) - 1):
                        for stop in range(start + 2, min(len(piece), start + longest) + 1):
                            run = piece[start:stop]
                            if run not in seen:
                                if len(seen) >= MEMO:
                                    seen.clear()
                                seen.add(run)
                                place = hashed(run, 42) % FILTER_BITS
                                if bits[place >> 3] >> (place & 7) & 1:
                                    lots.append(lot)
                                    runs.append(run)
            yield pa.RecordBatch.from_arrays([pa.array(lots, pa.int32()), pa.array(runs, pa.binary())], ["_lot", "token"])

    return dealt.mapInArrow(found, "_lot int, token binary")


def _join_vocab(files: DataFrame, vocab: DataFrame) -> DataFrame:
    """The same count with no broadcast: files are dealt into lots of LOT_BYTES of text, and each lot
    is joined with the entries that its pieces contain, every one once.

    Only these go to a lot's task, before its files, so neither the pieces of a file nor the whole
    vocabulary are moved or held.
    """
    vocab = vocab.select("token", "rank")
    names = [name for name in files.columns if name != "tokens"]
    rows = files.select(*names).toDF(*[f"c{k}" for k in range(len(names))])
    content = f"c{names.index('content')}"
    size = rows.agg(F.sum(F.octet_length(content).cast("bigint"))).first()[0] or 0
    lots = max(files.sparkSession.sparkContext.defaultParallelism, -(-size // LOT_BYTES))
    # By the whole row, so that copies of a text do not meet; a map has no hash.
    hashed = [name for name, kind in rows.dtypes if "map<" not in kind]
    rows = rows.withColumn("_lot", F.pmod(F.xxhash64(*hashed), F.lit(lots)).cast("int"))

    longest = vocab.agg(F.max(F.octet_length("token")).alias("longest")).first()[0] or 0
    dealt = rows.select("_lot", content).repartition(lots, "_lot").sortWithinPartitions("_lot")
    runs = _likely_entries(dealt.select("_lot", pieces(F.col(content))), vocab, int(longest))
    entries = materialise(runs).join(vocab, "token").select("_lot", F.col("token").alias("_token"), F.col("rank").alias("_rank"))

    schema = T.StructType([*rows.drop("_lot").schema.fields, T.StructField("tokens", T.LongType())])

    def counted(batches):
        lot, ranks, memo = None, {}, {}
        for batch in batches:
            turns = 2 * batch.column(0).to_numpy().astype(np.int64) + batch.column(1).is_null().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(turns, prepend=-1))
            for start, stop in zip(starts, [*starts[1:], len(batch)], strict=True):
                part = batch.slice(start, stop - start)
                if turns[start] >> 1 != lot:
                    lot, ranks, memo = turns[start] >> 1, {}, {}
                if turns[start] & 1:
                    arrays = [*part.columns[4:], _summed(part.column(3), ranks, memo)]
                    yield pa.RecordBatch.from_arrays(arrays, schema.names)
                else:
                    ranks.update(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True))

    both = entries.unionByName(rows, allowMissingColumns=True).repartition(lots, "_lot")
    both = both.sortWithinPartitions("_lot", F.col("_token").isNull())
    both = both.select("_lot", "_token", "_rank", pieces(F.col(content)).alias("_pieces"), *rows.drop("_lot").columns)
    return both.mapInArrow(counted, schema).toDF(*names, "tokens")
