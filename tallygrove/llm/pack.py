"""Packing: windows of a token stream, cut where padding and truncation cost least.

Documents are tokenised in place, dealt by ranges of their id, and read in order of id within a
range. A range's tokens are one stream, and a window of it is a sequence. Windows may end at the
end of a document, at the end of a sentence for a penalty, and elsewhere for a larger one where
there is no sentence end for long. A dynamic program picks the ends with the least padding plus
penalties: the best cost to a position is the least cost over starts at most `length` before it,
plus what fills the window up. That is a sliding minimum, kept in a monotone queue. A sequence
whose length is a power of two needs no padding.

The program runs over blocks of a bounded number of tokens, long documents in several; the last
window of a block is open and goes on in the next, so blocks cost no padding.

A null or empty text is its closing token alone. Rows of an equal id lie side by side but for the
ends of a range, repeated rows as documents of their own; null ids come first. Null ids go in as null. An empty table gives
an empty result.
"""

import re
from bisect import bisect_left
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import only, released

LENGTH = 2048
CLOSING = 1
SENTENCE_PENALTY = 2  # in tokens of padding
WORD_PENALTY = 16
LONGEST_STRETCH = 64  # without a sentence end, until other cuts are offered
STRIDE = 16  # between such cuts
SHORTEST_EXACT = 16  # of a sequence's length: no shorter windows for the sake of a power of two
BLOCK = 256 * LENGTH  # tokens the program sees at once
MEMO = 200_000  # words, marks and odd pieces, about 30 MB
LOT = 1 << 19  # characters whose words are looked up together
SHARD_ROWS = 10_000
MOST_SHARDS = 100_000  # a shard is streamed, so larger ones only sort more
SAMPLES = 20  # (id, tie) pairs a shard, from which the bounds are drawn
# What the tokenizer splits off by itself: letters, a digit, marks. A piece between blanks with
# anything else in it goes through the tokenizer whole, as do apostrophes, which begin endings
# of their own, and "<", which begins special tokens.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
APART = r"([0-9]|[!-&(-/:;=-@\[-`{-~]+)"  # what stands beside the words of a plain piece
ODD = re.compile(r"[^ -&(-;=-~\n\r\tÀ-ÖØ-öø-ÿ]")
BLANK = re.compile("[ \n\r\t]+")
WORD_END = "</w>"


class PieceEncoder:
    """Ids of whole texts as little-endian 32-bit numbers, equal to the tokenizer's own.

    Made for tokenizers that lower-case, drop white space and mark word ends: no token spans a
    blank, and what stands between blanks falls into words, digits and marks. These are looked up;
    unknown ones are encoded together and told apart by the word ends. Other tokenizers encode
    whole texts.

    Words are remembered, not what marks stand at them: when `MEMO` are young, those not seen
    since the last time go.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words that are lower-cased and split already.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.sentence_ends, self.word_ends = np.zeros(size, bool), np.zeros(size, bool)
        for token, number in vocabulary.items():
            self.word_ends[number] = token.endswith(WORD_END)
            self.sentence_ends[number] = token.removesuffix(WORD_END).endswith((".", "!", "?"))
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.young, self.old = {}, {}
        whole, parts = self.ids("Ab ab. 12"), [self.ids(x) for x in ("ab", "ab", ".", "1", "2")]
        self.by_part = whole.tolist() == np.concatenate(parts).tolist() and bool(self.word_ends[whole].any())

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, texts: list) -> list:
        """Each text's ids, as bytes of numbers of type `self.kind`."""
        if not self.by_part:
            return [self.ids(text).astype(self.kind).tobytes() for text in texts]
        lots, size = [[]], 0
        for text in texts:
            if size > LOT:
                lots, size = [*lots, []], 0
            lots[-1].append(text)
            size += len(text)
        return [ids for lot in lots for ids in self._encode_lot(lot)]

    def _encode_lot(self, texts: list) -> list:
        """Arrow splits plain texts and tells their different words, which alone Python looks up."""
        out, odd = [b""] * len(texts), set()
        others = [k for k, text in enumerate(texts) if ODD.search(text)]
        plain = sorted(set(range(len(texts))).difference(others))
        lower = pc.utf8_lower(pa.array([texts[k] for k in plain], pa.large_string()))
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, APART, r" \1 "))
        words = split.flatten().dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        pieces = [self._pieces(texts[k], odd) for k in others]
        if len(self.young) > MEMO:
            self.young, self.old = {}, self.young
        self.young[""] = b""
        fresh = set(different).union(*pieces).difference(self.young)
        if fresh:
            self._learn(fresh, odd)
        known = self.young.__getitem__
        for k, own in zip(others, pieces, strict=True):
            out[k] = b"".join(map(known, own))
        found = list(map(known, different))
        data = np.frombuffer(b"".join(found), self.kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        number = words.indices.to_numpy()
        begins, length = (np.cumsum(sizes) - sizes)[number], sizes[number]
        ends = np.append(0, np.cumsum(length))
        ids = data[np.arange(ends[-1]) + np.repeat(begins - ends[:-1], length)]
        stops = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        for k, low, high in zip(plain, stops, stops[1:], strict=False):
            out[k] = ids[low:high].tobytes()
        return out

    def _pieces(self, text, odd):
        """Of an odd text the words, digits and marks, lower-cased, and odd pieces as they are."""
        pieces = []
        for piece in BLANK.split(text):
            if ODD.search(piece):
                odd.add(piece)
                pieces.append(piece)
            else:
                pieces += PLAIN.findall(piece.lower())
        return pieces

    def _learn(self, fresh: set, odd: set):
        young, old = self.young, self.old
        if old:
            young.update((p, old[p]) for p in fresh if p in old)
        unknown = list(fresh.difference(odd).difference(young))
        ids = self.words.encode_batch_fast([" ".join(unknown)], add_special_tokens=False)[0].ids
        ids = np.array(ids, self.kind)
        stops = ((np.flatnonzero(self.word_ends[ids]) + 1) * ids.itemsize).tolist()
        data = ids.tobytes()
        young.update((p, data[a:b]) for p, a, b in zip(unknown, [0, *stops], stops, strict=False))
        young.update((p, self.ids(p).astype(self.kind).tobytes()) for p in fresh & odd if p not in young)


def cut_places(ids: np.ndarray, document_ends: np.ndarray, ends: np.ndarray, length: int) -> tuple:
    """Positions where a window may end, ascending, and what each costs."""
    cost = np.full(len(ids) + 1, -1, np.int16)
    cost[-1] = WORD_PENALTY
    cost[1:][ends[ids]] = SENTENCE_PENALTY
    cost[document_ends] = 0
    kept = np.flatnonzero(cost >= 0)
    before = np.append(0, kept[:-1])
    longest, stride = min(LONGEST_STRETCH, length // 2), max(1, min(STRIDE, length // 32))
    for k in np.flatnonzero(kept - before > longest).tolist():
        cost[before[k] + stride : kept[k] : stride] = WORD_PENALTY
    places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def best_cuts(places, costs, length: int = LENGTH) -> list:
    """The ends of the windows, up to the last place, with the least padding plus costs.

    cost[j] = min over i with places[j] - places[i] <= length of cost[i] + padding + costs[j],
    with padding = length - (places[j] - places[i]), or none where the window's size is a power
    of two (from a sixteenth of the length on). The first is a minimum of cost[i] + places[i] over a sliding range: a monotone queue.
    """
    places = np.append(0, places)
    exact = {}  # where a window of such a size would begin
    for size in (1 << k for k in range(length.bit_length()) if 1 << k >= length // SHORTEST_EXACT):
        start = np.searchsorted(places, places - size)
        for j in np.flatnonzero(places[start] == places - size).tolist():
            exact.setdefault(j, []).append(int(start[j]))
    places = places.tolist()
    total, back = [0] * len(places), [0] * len(places)
    queue = deque([(0, 0)])  # (cost + place, index), costs ascending
    for j, extra in enumerate(costs.tolist(), 1):
        place = places[j]
        while places[queue[0][1]] < place - length:
            queue.popleft()
        best, start = queue[0]
        best += length - place
        for i in exact.get(j, ()):
            if total[i] < best:
                best, start = total[i], i
        total[j], back[j] = best + extra, start
        value = best + extra + place
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(places[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Windows over one ordered stream of documents; `feed` and `close` yield pieces."""

    def __init__(self, ends: np.ndarray, length: int, first_sequence: int):
        self.ends, self.length, self.sequence = ends, length, first_sequence
        self.parts, self.size = [], 0  # (doc, start, document's tokens, ids)

    def feed(self, doc, ids: np.ndarray):
        for start in range(0, len(ids), BLOCK):
            part = ids[start : start + BLOCK]
            self.parts.append((doc, start, len(ids), part))
            self.size += len(part)
            if self.size >= BLOCK:
                yield from self._pack(open_end=True)

    def close(self):
        if self.size:
            yield from self._pack(open_end=False)

    def _pack(self, open_end: bool):
        ids = np.concatenate([p[3] for p in self.parts])
        ends = np.cumsum([len(p[3]) for p in self.parts])
        whole = [start + len(part) == total for _, start, total, part in self.parts]
        cuts = best_cuts(*cut_places(ids, ends[np.array(whole, bool)], self.ends, self.length), self.length)
        if open_end and len(cuts) > 1:
            cuts.pop()
        stop, index, offset = cuts[-1], 0, 0
        starts = ends - [len(p[3]) for p in self.parts]
        low = 0
        for cut in cuts:
            offset = 0
            while low < cut:
                doc, start, total, part = self.parts[index]
                high = min(cut, int(ends[index]))
                inner = low - int(starts[index])
                yield doc, start + inner, high - low, total, self.sequence, offset, part[inner : inner + high - low]
                offset += high - low
                low = high
                index += low == ends[index]
            self.sequence += 1
        rest = []
        if stop < len(ids):
            doc, start, total, part = self.parts[index]
            inner = stop - int(starts[index])
            rest = [(doc, start + inner, total, part[inner:]), *self.parts[index + 1 :]]
        self.parts, self.size = rest, len(ids) - stop


def pack(
    documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH
) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    `ids` are little-endian unsigned 32-bit numbers. `tokenizer` is the path of a tokenizer file
    that every executor has. The only shuffle moves ids, by ranges of `doc_id` and, among rows of
    equal or null ids, of a hash of the text, so that these are spread, too. The ranges are quantiles
    of a sample with `SAMPLES` rows for each of them.
    """
    texts = only(documents, **{doc_id: "bigint", text: "string"}).toDF("doc_id", "text")
    shards = max(texts.sparkSession.sparkContext.defaultParallelism, texts.count() // SHARD_ROWS)
    shards = min(shards, MOST_SHARDS)
    texts = texts.withColumn("tie", F.xxhash64("text"))
    step = max(1, texts.count() // (shards * SAMPLES))
    drawn = texts.where(F.pmod(F.xxhash64("tie", "doc_id"), F.lit(step)) == 0).select("doc_id", "tie").distinct()
    drawn = [(d is not None, d or 0, tie) for d, tie in drawn.orderBy("doc_id", "tie").toLocalIterator()]
    bounds = sorted({drawn[k * len(drawn) // shards] for k in range(1, shards)}) if drawn else []
    encoder = PieceEncoder(tokenizer)
    sentence_ends = encoder.sentence_ends
    width = encoder.kind
    closing = np.array([CLOSING], width).tobytes()

    # Kept by each Python worker over its tasks: loaded once, and words stay known.
    kept = texts.sparkSession.sparkContext.broadcast({})

    def encoded(batches):
        encoder = kept.value.get(tokenizer) or kept.value.setdefault(tokenizer, PieceEncoder(tokenizer))
        for batch in released(batches):
            docs, texts, ties = (column.to_pylist() for column in batch.columns)
            ids = [x + closing for x in encoder.encode([t or "" for t in texts])]
            shard = [bisect_left(bounds, (d is not None, d or 0, tie)) for d, tie in zip(docs, ties, strict=True)]
            columns = [pa.array(shard, pa.int32()), batch.column(0), batch.column(2), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "tie", "ids"])

    tokens = texts.mapInArrow(encoded, "shard int, doc_id bigint, tie bigint, ids binary")
    ordered = tokens.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "tie")

    def packed(batches):
        packer, shard = None, None
        for batch in released(batches):
            pieces = []
            for number, doc, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != shard:
                    pieces += packer.close() if packer else ()
                    packer, shard = Packer(sentence_ends, length, number << 40), number
                pieces += packer.feed(doc, np.frombuffer(ids, width))
            if pieces:
                yield as_batch(pieces)
        if packer:
            yield as_batch(list(packer.close()))

    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def as_batch(pieces):
        columns = [pa.array([p[k] for p in pieces], pa.int64()) for k in range(6)]
        ids = pa.array([p[6].astype("<u4").tobytes() for p in pieces], pa.binary())
        return pa.RecordBatch.from_arrays([*columns, ids], names)

    return ordered.select("shard", "doc_id", "ids").mapInArrow(
        packed, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    )
