"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are runs of code points other than ASCII punctuation, space and controls, A-Z lower-cased.
The automaton holds every run of words of every item. A document's words are streamed through
it; at each word it knows the longest matching length that ends there. A length of at least
`window` means that the last `window` words are a window of some item, and all of them are hit.
An item of fewer words, but not none, is one window by itself.

Words that no item holds, and neighbours that no item holds side by side, end any match, so only
runs of known neighbours go through the automaton, with an equal result.

Items are a fixed test set, not corpus rows: they come to the driver one automaton at a time, an
automaton holds at most `ITEM_WORDS` words, and documents pass through all of them in turn.

Null and empty texts have no words: not hit, coverage 0. Null or empty items have no window.
Items without an id are one item, a null at the end of `items`.
Repeated rows get equal results; items of an equal id count once. Empty tables give an empty
result, or no hits.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import extended, numbered, only, released, utf8

WINDOW = 10
ITEM_WORDS = 200_000  # of one automaton
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text: bytes) -> list:
    return text.translate(WORD_BYTES).split()


class ItemAutomaton:
    """Generalised suffix automaton over the word numbers of (item id, words) pairs."""

    def __init__(self, items: list, window: int = WINDOW):
        self.window = window
        self.number = {}
        sequences = [(i, [self.number.setdefault(w, len(self.number)) for w in ws]) for i, ws in items if ws]
        self.next, self.link, self.length = [{}], [-1], [0]
        own = {}
        for item, numbers in sequences:
            state = 0
            for number in numbers:
                state = self._extend(state, number)
                own.setdefault(state, set()).add(item)
        self._mark(sequences, own)
        self.least = min([window, *(len(n) for _, n in sequences)])
        self.pairs = np.unique([a * len(self.number) + b for _, n in sequences for a, b in zip(n, n[1:])] or [-1])

    @classmethod
    def of(cls, tables: dict):
        """The automaton with these tables, `vars` of another: they are sent as plain values."""
        automaton = cls.__new__(cls)
        vars(automaton).update(tables)
        return automaton

    def _state(self, length, link, following):
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state, number, target):
        """The state for what is reached by `number` at one more than the length of `state`."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(number) == target:
            self.next[state][number] = copy
            state = self.link[state]
        return copy

    def _extend(self, last, number):
        if number in self.next[last]:
            return self._split(last, number, self.next[last][number])
        new = self._state(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and number not in self.next[state]:
            self.next[state][number] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, number, self.next[state][number])
        return new

    def _mark(self, sequences, own):
        """For each state the items that hold the last `window` words of its runs, and short items."""
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        below = [own.get(state, set()) for state in range(len(self.next))]
        for state in reversed(by_length):
            below[self.link[state]] = below[self.link[state]] | below[state]
        self.items = [frozenset()] * len(self.next)
        for state in by_length:
            up = self.link[state]
            if self.length[up] >= self.window:
                self.items[state] = self.items[up]
            elif self.length[state] >= self.window:
                self.items[state] = frozenset(below[state])
        # Items shorter than a window, as (length, item), along the links.
        short = {}
        for item, numbers in sequences:
            if len(numbers) < self.window:
                state = 0
                for number in numbers:
                    state = self.next[state][number]
                short.setdefault(state, []).append((len(numbers), item))
        self.short = [()] * len(self.next)
        for state in by_length:
            self.short[state] = (*self.short[self.link[state]], *short.get(state, ()))

    def matches(self, tokens: list) -> tuple:
        """[(first word, end)] of hit spans, in order and apart, and the items that occur."""
        if len(tokens) < self.least:
            return [], set()
        number = self.number
        numbers = np.fromiter((number.get(t, -1) for t in tokens), np.int64, len(tokens))
        spans, found = [], set()
        for start, end in self._runs(numbers):
            self._stream(numbers[start:end].tolist(), start, spans, found)
        return spans, found

    def _runs(self, numbers):
        """Runs, long enough to matter, of known words that are known neighbours."""
        if self.least == 1:
            joined = (numbers[:-1] >= 0) & (numbers[1:] >= 0)
        else:
            keys = np.where((numbers[:-1] >= 0) & (numbers[1:] >= 0), numbers[:-1] * len(self.number) + numbers[1:], -2)
            joined = self.pairs[np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)] == keys
        breaks = np.flatnonzero(~joined) + 1
        starts, ends = np.append(0, breaks), np.append(breaks, len(numbers))
        kept = (ends - starts >= self.least) & (numbers[starts] >= 0)
        return zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)

    def _stream(self, numbers, offset, spans, found):
        following, link, lengths = self.next, self.link, self.length
        state = length = 0
        for at, number in enumerate(numbers, offset + 1):
            while state and number not in following[state]:
                state = link[state]
                length = lengths[state]
            if number in following[state]:
                state = following[state][number]
                length += 1
            hit = 0
            if length >= self.window:
                hit = length
                found |= self.items[state]
            for size, item in self.short[state]:
                if size <= length:
                    found.add(item)
                    hit = max(hit, size)
            if hit:
                start = at - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at))


def automata(benchmark: DataFrame, item_id: str, text: str, window: int, item_words: int):
    """One automaton after another, of at most `item_words` words each or of one item."""
    held, size = [], 0
    items = only(benchmark, **{item_id: "string", text: "string"}).dropna(subset=[text]).dropDuplicates()
    for row in items.orderBy(item_id, text).toLocalIterator():
        sequence = words(row[text].encode())
        if held and size + len(sequence) > item_words:
            yield ItemAutomaton(held, window)
            held, size = [], 0
        held.append((row[item_id], sequence))
        size += len(sequence)
    yield ItemAutomaton(held, window)


def with_matches(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    item_words: int = ITEM_WORDS,
    cut: bool = False,
) -> DataFrame:
    """All columns of `documents` with `n_words`, `hit_spans` and `items`.

    `hit_spans` are [first word, end) pairs, in order and not touching; `items` the ids, as
    sorted strings, of items with a window that occurs. Such columns of `documents` are replaced.
    With `cut`, `text` comes without the words of the spans, in the same pass: another one would hold
    another Python worker a core.
    """
    kept = documents.drop("n_words", "hit_spans", "items")
    place = kept.columns.index(text)
    found = numbered(kept)
    spans_type = "array<struct<start:bigint,end:bigint>>"
    schema = extended(found, n_words="bigint", hit_spans=spans_type, items="array<string>")
    names, span = schema.names, pa.struct([("start", pa.int64()), ("end", pa.int64())])
    rest, number = automata(benchmark, item_id, item_text, window, item_words), 0
    automaton = next(rest)
    while automaton:
        sent = documents.sparkSession.sparkContext.broadcast(vars(automaton))
        automaton = next(rest, None)

        def matched(batches, sent=sent, number=number, cutting=cut and not automaton):
            automaton = ItemAutomaton.of(sent.value)
            for batch in released(batches):
                counts, spans, items = [], [], []
                before = [x.to_pylist() for x in batch.columns[-2:]] if number else None
                for row, data in enumerate(utf8(batch.column(place))):
                    tokens = words(data)
                    hits, ids = automaton.matches(tokens)
                    if number:
                        hits = united(hits + [(s["start"], s["end"]) for s in before[0][row]])
                        ids = ids | set(before[1][row])
                    counts.append(len(tokens))
                    spans.append([{"start": a, "end": b} for a, b in hits])
                    items.append(sorted(ids, key=lambda i: (i is None, i or "")))
                columns = batch.columns[:-3] if number else batch.columns
                if cutting:
                    columns[place] = _cut(columns[place], spans)
                added = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, *added], names)

        found, number = found.mapInArrow(matched, schema), number + 1
    return found.toDF(*kept.columns, *names[-3:])


def united(spans: list) -> list:
    """Spans in order; those that overlap or touch as one."""
    out = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def without_spans(text: bytes, spans: list) -> bytes:
    """The text without the words of the spans and what stands between these words."""
    places = [m.span() for m in WORD.finditer(text.lower())]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def _cut(texts: pa.Array, spans: list) -> pa.Array:
    """A column of texts, each without the words of its own list of spans."""
    pairs = zip(texts.cast(pa.binary()).to_pylist(), spans, strict=True)
    kept = [without_spans(t, [(s["start"], s["end"]) for s in x]) if x else t for t, x in pairs]
    return pa.array(kept, pa.binary()).cast(pa.string())


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    most_coverage: float = 0.5,
    window: int = WINDOW,
    **options,
) -> DataFrame:
    """The columns of `documents`: hit spans removed from `text`, rows above the coverage dropped.

    Coverage is the share of a document's words that are hit. A text without hits is left as it is.
    """
    rows, place = numbered(documents), documents.columns.index(text)
    names = rows.columns
    found = with_matches(rows, benchmark, names[place], window=window, cut=True, **options)
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    kept = found.where(hit <= F.lit(most_coverage) * F.col("n_words"))
    return kept.select(*names).toDF(*documents.columns)

