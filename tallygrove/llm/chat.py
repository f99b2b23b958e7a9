"""Chat formatting: a hidden Markov model recovers the roles of a transcript's lines.

A transcript is the lines of its rows, in order of `turn`. Each line is observed by its speaker
marker ("User:", "[assistant]", "**Q:**", "> ", another name and a colon, none), its length, a
question mark at its end, and whether a blank line stands before it. The hidden states are the
first and the further lines of a turn of each role. Start, transition and observation
probabilities are counted over all labelled rows, Viterbi finds the likeliest states, and turns
are rendered with one heading a turn, markers removed.

A conversation is streamed in order by one task, which holds a part of it: a part ends with each
block of `BLOCK_TURNS` turn numbers and at the next row after `PART_BYTES` of text. The model goes
on over these cuts: a line is settled once the likeliest paths to all states agree on it, which
takes few lines after it, and lines not yet settled are held. So the roles are those of the uncut
conversation, and the texts of its rows, put together in order, are its transcript: a turn that
spans a cut has its heading and its role in the row where it begins.

Null and empty texts are one empty line. Rows with a null turn come first, in block 0; rows of an
equal turn lie in order of their text, repeated rows are repeated. Rows without a conversation id
are one conversation. An empty table gives an empty result. In `fit`, rows of other roles are no
evidence; with no evidence all probabilities are equal.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import only

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # of role r: 2 r begins a turn, 2 r + 1 goes on with it
BLOCK_TURNS = 4096
PART_BYTES = 8 << 20

NAMES = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "you", "me"),
    "assistant": ("assistant", "ai", "bot", "model", "agent", "answer", "a"),
}
ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
MARKER = re.compile(
    r"\s*(?:[*_#\[<|(]+\s*)?(" + "|".join(sorted(ROLE_OF, key=len, reverse=True)) + r")(?:\s*[\]|>)*_]+\s*:?|\s*:)[*_]*\s*",
    re.IGNORECASE,
)
OTHER_NAME = re.compile(r"\s*[^\W\d_][\w .'-]{0,30}:\s")
QUOTE = re.compile(r"\s*>\s?")
KINDS = (*ROLES, "other", "quote", "none")
LENGTHS = (1, 40, 160, 640)
OBSERVED = (len(KINDS), len(LENGTHS) + 1, 2, 2)  # values of each observation


@dataclass(frozen=True)
class RoleModel:
    """Log probabilities: `start[s]`, `move[s, t]`, and for each observation `seen[s, value]`."""

    start: np.ndarray
    move: np.ndarray
    seen: list


def marker(line: str) -> tuple:
    """(kind, where the text after the marker begins)."""
    found = MARKER.match(line)
    if found:
        return KINDS.index(ROLE_OF[found[1].lower()]), found.end()
    if OTHER_NAME.match(line):
        return KINDS.index("other"), 0
    found = QUOTE.match(line)
    return (KINDS.index("quote"), found.end()) if found else (KINDS.index("none"), 0)


def observe(lines: list, after_blank: int = 0) -> np.ndarray:
    """One row of observed values for each line; `after_blank`: whether a blank one stands before."""
    found = []
    for line in lines:
        size = len(line.strip())
        found.append(
            (marker(line)[0], sum(size >= n for n in LENGTHS), int(line.rstrip().endswith("?")), after_blank)
        )
        after_blank = int(not size)
    return np.array(found, np.int64).reshape(len(lines), len(OBSERVED))


def likeliest(observed: np.ndarray, model: RoleModel) -> list:
    """The states of the likeliest path (Viterbi). A transcript begins with the beginning of a turn."""
    if not len(observed):
        return []
    emitted = sum(table[:, observed[:, k]] for k, table in enumerate(model.seen)).T
    score = model.start + emitted[0]
    back = np.zeros((len(observed), STATES), np.int8)
    every = np.arange(STATES)
    for at in range(1, len(observed)):
        paths = score[:, None] + model.move
        back[at] = paths.argmax(axis=0)
        score = paths[back[at], every] + emitted[at]
    states = [int(score.argmax())]
    for at in range(len(observed) - 1, 0, -1):
        states.append(int(back[at, states[-1]]))
    return states[::-1]


class Decoder:
    """Viterbi over a conversation that comes piece by piece; see `likeliest`."""

    def __init__(self, model: RoleModel):
        self.model, self.score, self.lines, self.back, self.after_blank = model, None, [], [], 0

    def add(self, lines: list) -> list:
        """Takes (line, where) pairs; gives those that are settled now, as (line, where, state)."""
        observed = observe([line for line, _ in lines], self.after_blank)
        emitted = sum(table[:, observed[:, k]] for k, table in enumerate(self.model.seen)).T
        every = np.arange(STATES)
        for row in emitted:
            if self.score is None:
                self.score = self.model.start + row
                self.back.append(every)
                continue
            paths = self.score[:, None] + self.model.move
            self.back.append(paths.argmax(axis=0))
            self.score = paths[self.back[-1], every] + row
        self.lines += lines
        self.after_blank = int(not lines[-1][0].strip())
        states = every
        for at in range(len(self.lines) - 1, 0, -1):
            states = self.back[at][states]
            if (states == states[0]).all():
                return self._settled(at, int(states[0]))
        return []

    def rest(self) -> list:
        return self._settled(len(self.lines), int(self.score.argmax())) if self.lines else []

    def _settled(self, n: int, state: int) -> list:
        """The first n lines, of which the last has that state."""
        states = [state]
        for at in range(n - 1, 0, -1):
            states.append(int(self.back[at][states[-1]]))
        done = [(line, where, state) for (line, where), state in zip(self.lines[:n], states[::-1], strict=True)]
        self.lines, self.back = self.lines[n:], self.back[n:]
        return done


class Transcript:
    """Renders settled lines: one heading a turn, markers of first lines and blank ends removed."""

    def __init__(self):
        self.any, self.written, self.blank = False, False, ""
        self.text, self.roles, self.n = [], [], 0

    def add(self, line: str, state: int) -> None:
        if self.begins(state):
            role = ROLES[state // 2]
            self.end()
            self.any, self.written, self.blank = True, False, ""
            self.roles.append(role)
            self.text.append(f"<|{role}|>\n")
            line = line[marker(line)[1] :]
        else:
            line = "\n" + line
        whole = self.blank + line
        body = (whole if self.written else whole.lstrip()).rstrip()
        if body:
            self.text.append(body)
            self.written = True
        self.blank = whole[len(whole.rstrip()) :] if self.written else ""
        self.n += 1

    def begins(self, state: int) -> bool:
        return not (state % 2 and self.any)

    def end(self) -> None:
        if self.any:
            self.text.append("\n")
        self.any = False

    def taken(self) -> tuple:
        """(lines, roles, text) since the last call."""
        found = self.n, self.roles, "".join(self.text)
        self.n, self.roles, self.text = 0, [], []
        return found


def _ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, block, role, text) with each conversation's rows side by side and in order."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(0)).cast("bigint").alias("block")
    rows = rows.select("conv_id", block, "turn", "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "turn", "text")
    return ordered.select("conv_id", "block", "role", "text")


def _parts(batches):
    """((conv_id, block), number, [(role, text)]) of each part, in order."""
    key, number, held, size = None, 0, [], 0
    for batch in batches:
        for conversation, block, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if held and ((conversation, block) != key or size >= PART_BYTES):
                yield key, number, held
                number = number + 1 if (conversation, block) == key else 0
                held, size = [], 0
            key = (conversation, block)
            held.append((role, text))
            size += len(text)
    if held:
        yield key, number, held


def _named(conversations: DataFrame, conv_id: str, turn: str, text: str, role: str | None) -> DataFrame:
    names = {conv_id: "bigint", turn: "bigint", text: "string"} | ({role: "string"} if role else {})
    rows = only(conversations, **names)
    if not role:
        rows = rows.withColumn("_role", F.lit(None).cast("string"))
    return rows.toDF("conv_id", "turn", "text", "role")


def fit(conversations: DataFrame, conv_id="conv_id", turn="turn", text="text", role="role") -> RoleModel:
    """Count over rows of known roles. The driver gets one number a probability."""
    offsets = np.cumsum([0, STATES, STATES * STATES, *(STATES * n for n in OBSERVED)])

    def counted(batches):
        counts = np.zeros(offsets[-1], np.int64)
        conversation, before, after_blank = (), None, 0
        for (own_id, _), _, held in _parts(batches):
            if (own_id,) != conversation:
                conversation, before, after_blank = (own_id,), None, 0
            lines, states = [], []
            for name, piece in held:
                if name in ROLES:
                    own = piece.split("\n")
                    lines += own
                    states += [2 * ROLES.index(name)] + [2 * ROLES.index(name) + 1] * (len(own) - 1)
            if not lines:
                continue
            states = np.array(states)
            observed = observe(lines, after_blank)
            if before is None:
                counts[states[0]] += 1
            else:
                counts[offsets[1] + before * STATES + states[0]] += 1
            before, after_blank = states[-1], int(not lines[-1].strip())
            np.add.at(counts, offsets[1] + states[:-1] * STATES + states[1:], 1)
            for k, n in enumerate(OBSERVED):
                np.add.at(counts, offsets[2 + k] + states * n + observed[:, k], 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["place", "n"])

    rows = _named(conversations, conv_id, turn, text, role)
    sums = _ordered(rows).mapInArrow(counted, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    counts = np.ones(offsets[-1])
    for row in sums.collect():
        counts[row["place"]] += row["n"]
    start, move, *seen = (counts[a:b] for a, b in zip(offsets, offsets[1:]))
    start = start.copy()
    start[1::2] = 1e-9  # nothing to go on with yet

    def logs(table):
        return np.log(table / table.sum(axis=-1, keepdims=True))

    return RoleModel(
        logs(start), logs(move.reshape(STATES, STATES)), [logs(s.reshape(STATES, n)) for s, n in zip(seen, OBSERVED)]
    )


def parse(conversations: DataFrame, model: RoleModel, conv_id="conv_id", turn="turn", text="text") -> DataFrame:
    """(conv_id, block, part, n_lines, roles, text): canonical turns of each part of a transcript.

    `roles` has the role of each turn that begins in the part, in order. Roles that the table may hold are not read.
    """
    start, move, seen = model.start, model.move, model.seen

    def parsed(batches):
        model = RoleModel(start, move, seen)
        decoder = None

        def row(where):
            conversation, block, number = where
            n, roles, text = transcript.taken()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([conversation], pa.int64()),
                    pa.array([block], pa.int64()),
                    pa.array([number], pa.int32()),
                    pa.array([n], pa.int64()),
                    pa.array([roles], pa.list_(pa.string())),
                    pa.array([text], pa.string()),
                ],
                ["conv_id", "block", "part", "n_lines", "roles", "text"],
            )

        def written(settled):
            nonlocal at
            for line, where, state in settled:
                if at is not None and where != at:
                    if transcript.begins(state):
                        transcript.end()
                    yield row(at)
                at = where
                transcript.add(line, state)

        def ended():
            yield from written(decoder.rest())
            transcript.end()
            yield row(at)

        for (conversation, block), number, held in _parts(batches):
            if decoder is None or conversation != at_conversation:
                if decoder:
                    yield from ended()
                decoder, transcript, at, at_conversation = Decoder(model), Transcript(), None, conversation
            where = (conversation, block, number)
            yield from written(decoder.add([(line, where) for _, piece in held for line in piece.split("\n")]))
        if decoder:
            yield from ended()

    rows = _named(conversations, conv_id, turn, text, None)
    return _ordered(rows).mapInArrow(
        parsed, "conv_id bigint, block bigint, part int, n_lines bigint, roles array<string>, text string"
    )


# How speakers are marked in raw transcripts, a style a conversation; roles without a marker are bare.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "Instructions: ", "user": "Human: ", "assistant": "AI: "},
    {"system": "[system] ", "user": "**Q:** ", "assistant": "**A:** "},
    {"system": "### Context: ", "user": "> ", "assistant": ""},
)


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows as a raw transcript has them, in one style a conversation."""
    rows = only(conversations, conv_id="bigint", turn="bigint", role="string", text="string")
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    prefix = F.lit("")
    for number, marks in enumerate(STYLES):
        for role, mark in marks.items():
            prefix = F.when((style == number) & (F.col("role") == role), F.lit(mark)).otherwise(prefix)
    return rows.withColumn("text", F.concat(prefix, F.coalesce("text", F.lit(""))))
