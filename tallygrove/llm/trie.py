"""Conversation prefix trie: what is shared by conversations that begin alike.

A node stands for a distinct sequence of first turns. Conversations are put in order of their turns'
digests, so the members of a node are neighbours, and cut into shards of neighbours. A shard's trie
is a sequence of balanced parentheses, '(' where the walk enters a node and ')' where it leaves. The
minima of the excess in blocks, and of these in a tree, lead `findclose` to the end of a subtree;
the rank of pairs '()' up to there counts its leaves, and sums over the nodes in order of entry give
its savings.

Nodes on the way to the first and to the last conversation of a shard are its spines: the shards
beside it may hold them, too. They leave the shard with what it knows of them, and are merged by
one walk over all spines in order; everything else is finished in its shard. Spines are two rows
for each shard of up to `SHARD_TURNS` turns, so the walk sees few rows; it holds one way from the
root down. Nodes below a spine learn their parent's name by a join on its key.

Texts are not moved. A turn is 16 bytes of SHA-256 over its role and text, a conversation one row
of 24 bytes a turn. A frequent beginning, or a third of all conversations alike, is cut by
conversation id, and the pieces of their lists of ids are hashed one after the other.

Turns are in order of `turn`, null first; equal ones by their digest. A null role or text is empty.
Rows without a conversation id belong to none and are left out. Repeated rows are repeated turns.
An empty table gives no nodes. Other columns are not looked at.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import only
from tallygrove.session import materialise

WIDTH = 16  # bytes of a turn's digest
SHARD_TURNS = 1 << 17
EXCESS_BLOCK = 32
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A balanced sequence with a tree of the minima of its excess."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens.astype(bool)
        self.excess = np.cumsum(np.where(self.opens, 1, -1))
        blocks = 1 << max(0, (-(-len(opens) // EXCESS_BLOCK) - 1).bit_length())
        padded = np.full(blocks * EXCESS_BLOCK, len(opens) + 1)
        padded[: len(opens)] = self.excess
        self.padded = padded
        # Node 1 is the root, 2k and 2k + 1 are below k; the blocks come last.
        self.least = np.empty(2 * blocks, np.int64)
        self.least[blocks:] = padded.reshape(blocks, EXCESS_BLOCK).min(axis=1)
        size = blocks
        while size > 1:
            self.least[size // 2 : size] = self.least[size : 2 * size].reshape(-1, 2).min(axis=1)
            size //= 2
        self.blocks = blocks
        pairs = self.opens.copy()
        pairs[:-1] &= ~self.opens[1:]
        pairs[-1:] = False
        self.pairs = pairs

    def _scan(self, at: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The first place from `at` to the end of its block with the excess `goal`; -1 if none."""
        found = np.full(len(at), -1)
        todo = np.arange(len(at))
        at = at.copy()
        while len(todo):
            hit = self.padded[at] == goal[todo]
            found[todo[hit]] = at[hit]
            more = ~hit & ((at + 1) % EXCESS_BLOCK != 0)
            at, todo = at[more] + 1, todo[more]
        return found

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Where each of the '(' at `at` is closed: the next place with an excess one less."""
        goal = self.excess[at] - 1
        found = self._scan(at, goal)
        todo = np.flatnonzero(found < 0)
        if not len(todo):
            return found
        node, wanted = at[todo] // EXCESS_BLOCK + self.blocks, goal[todo]
        # Up, to the first right neighbour that goes low enough; then down to its first such block.
        up = np.arange(len(todo))
        while len(up):
            right = (node[up] % 2 == 0) & (self.least[node[up] ^ 1] <= wanted[up])
            node[up[right]] += 1
            up = up[~right]
            node[up] //= 2
        down = np.flatnonzero(node < self.blocks)
        while len(down):
            node[down] *= 2
            node[down] += self.least[node[down]] > wanted[down]
            down = down[node[down] < self.blocks]
        found[todo] = self._scan((node - self.blocks) * EXCESS_BLOCK, wanted)
        return found


def shared_turns(a: bytes, b: bytes) -> int:
    """How many first turns two conversations have in common."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // WIDTH
    apart = np.frombuffer(a[:size], "<u8") != np.frombuffer(b[:size], "<u8")
    return int(np.argmax(apart)) // (WIDTH // 8)


def spine_keys(turns: bytes) -> list:
    """A key for the node at each depth of a conversation's way."""
    digest = hashlib.blake2b(digest_size=WIDTH)
    keys = [digest.digest()]
    for at in range(0, len(turns), WIDTH):
        digest.update(turns[at : at + WIDTH])
        keys.append(digest.copy().digest())
    return keys


class Shard:
    """The trie of neighbouring conversations [(id, digests, lengths)], in order."""

    def __init__(self, rows: list):
        self.turns = [turns for _, turns, _ in rows]
        self.ids = np.array([doc for doc, _, _ in rows], np.int64)
        depths = np.array([len(t) // WIDTH for t in self.turns])
        shared = np.array([0, *(shared_turns(a, b) for a, b in zip(self.turns, self.turns[1:]))])
        new = depths - shared
        closed = np.append(0, depths[:-1] - shared[1:])
        steps = np.stack([closed, new], axis=1).reshape(-1)
        marks = np.tile([0, 1], len(rows))
        opens = np.repeat([1, *marks, 0], [1, *steps, depths[-1] + 1])
        self.sequence = Parentheses(opens)
        # Nodes in order of entry; the root is node 0.
        begins = np.cumsum(new) - new
        inner = np.arange(new.sum()) - np.repeat(begins, new)
        self.depth = np.append(0, inner + np.repeat(shared, new) + 1)
        lengths = np.concatenate([np.asarray(x, np.int64) for _, _, x in rows])
        self.length = np.append(0, lengths[np.repeat(np.cumsum(depths) - depths, new) + self.depth[1:] - 1])
        self.attached = np.cumsum(new)  # the node where each conversation ends
        self.parent, self.last_way = self._parents(shared.tolist(), new.tolist())
        self.first_way = list(range(depths[0] + 1))

        enter = np.flatnonzero(opens)
        leave = self.sequence.findclose(enter)
        count = len(enter)
        end = np.arange(count) + (leave - enter + 1) // 2  # the node after the subtree
        first, last = np.searchsorted(self.attached, np.arange(count)), np.searchsorted(self.attached, end)
        self.members = last - first
        spans = np.stack([first, last], axis=1).reshape(-1)
        self.least = np.minimum.reduceat(np.append(self.ids, np.iinfo(np.int64).max), spans)[::2]
        self.ends = first, np.searchsorted(self.attached, np.arange(count), side="right")
        self.spine = np.zeros(count, bool)
        self.spine[self.first_way] = self.spine[self.last_way] = True
        # What spines weigh, and whether they are leaves, is known only after they are merged.
        weight = np.append(0, np.cumsum(np.where(self.spine, 0, (self.members - 1) * self.length)))
        self.saved = weight[end] - weight[:-1]
        pairs = self.sequence.pairs.copy()
        pairs[enter[self.spine]] = False
        rank = np.append(0, np.cumsum(pairs))
        self.leaves = rank[leave] - rank[enter]
        self.children = np.bincount(self.parent[1:][~self.spine[1:]], minlength=count)

    def _parents(self, shared, new):
        parent, way, count = np.zeros(1 + sum(new), np.int64), [0], 1
        for common, more in zip(shared, new, strict=True):
            del way[common + 1 :]
            for _ in range(more):
                parent[count] = way[-1]
                way.append(count)
                count += 1
        return parent, way

    def end_ids(self, node: int) -> str:
        return ",".join(map(str, self.ids[self.ends[0][node] : self.ends[1][node]].tolist()))

    def nodes(self) -> pa.RecordBatch:
        """The finished nodes; those below a spine with their parent's key in place of its name."""
        inner = np.flatnonzero(~self.spine)
        parent = self.parent[inner]
        below_spine = self.spine[parent]
        keys = {}
        for way, turns in ((self.first_way, self.turns[0]), (self.last_way, self.turns[-1])):
            keys.update(zip(way, spine_keys(turns), strict=True))
        ends = [
            hashlib.sha256(self.end_ids(k).encode()).hexdigest() if self.ends[0][k] < self.ends[1][k] else NO_ENDS
            for k in inner.tolist()
        ]
        columns = {
            "conv_id": pa.array(self.least[inner]),
            "depth": pa.array(self.depth[inner]),
            "parent_conv_id": pa.array(self.least[parent], mask=below_spine),
            "n_convs": pa.array(self.members[inner]),
            "n_children": pa.array(self.children[inner]),
            "n_leaves": pa.array(self.leaves[inner]),
            "saved_tokens": pa.array(self.saved[inner]),
            "ends_sha256": pa.array(ends, pa.string()),
            "parent_key": pa.array([keys[p] if s else None for p, s in zip(parent.tolist(), below_spine.tolist())], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def spines(self) -> list:
        """The ways to the last and to the first conversation; of the first what isn't on the last."""
        ways = []
        common = sum(a == b for a, b in zip(self.first_way, self.last_way))
        for side, way, row, start in ((0, self.first_way, 0, common), (1, self.last_way, -1, 0)):
            some = way[start:]
            if some:
                known = {
                    name: [int(x) for x in getattr(self, name)[some]]
                    for name in ("members", "least", "leaves", "children", "saved")
                }
                known |= {"length": self.length[way].tolist(), "ends": [self.end_ids(k) for k in some]}
                ways.append({"side": side, "turns": self.turns[row], "start": start, **known})
        return ways


NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
SPINE = (
    "part int, block int, side int, turns binary, start int, length array<bigint>, members array<bigint>, "
    "least array<bigint>, leaves array<bigint>, children array<bigint>, saved array<bigint>, ends array<string>"
)
_LISTS = pa.list_(pa.int64())
_SPINE_TYPE = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("side", pa.int32()), ("turns", pa.binary()), ("start", pa.int32())]
    + [(name, _LISTS) for name in ("length", "members", "least", "leaves", "children", "saved")]
    + [("ends", pa.list_(pa.string()))]
)


def _shards(batches):
    """Nodes, and spines in a column of their own, of the shards of one partition."""
    part, block, held, size = TaskContext.get().partitionId(), 0, [], 0

    def close():
        shard = Shard(held)
        nodes = shard.nodes()
        spines = [{"part": part, "block": block, **s} for s in shard.spines()]
        spines = pa.array(spines, pa.struct(_SPINE_TYPE))
        some = pa.nulls(len(nodes), spines.type)
        yield pa.RecordBatch.from_arrays([*nodes.columns, some], [*nodes.schema.names, "spine"])
        none = [pa.nulls(len(spines), kind) for kind in nodes.schema.types]
        yield pa.RecordBatch.from_arrays([*none, spines], [*nodes.schema.names, "spine"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += 1 + len(row[2])
            if size >= SHARD_TURNS:
                yield from close()
                block, held, size = block + 1, [], 0
    if held:
        yield from close()


class Merged:
    """A node of the merged spines while the walk is below it."""

    def __init__(self, key, depth, length):
        self.key, self.depth, self.length = key, depth, length
        self.members = self.leaves = self.children = self.saved = 0
        self.least = None
        self.spine_children = self.spine_leaves = self.spine_saved = 0
        self.ends, self.digest = False, hashlib.sha256()

    def add(self, members, least, leaves, children, saved, ends):
        self.members += members
        self.least = least if self.least is None else min(least, self.least)
        self.leaves += leaves
        self.children += children
        self.saved += saved
        if ends:
            self.digest.update(("," if self.ends else "").encode() + ends.encode())
            self.ends = True

    def close(self, parent):
        """The node's row. Its own part in leaves and savings goes up to its parent."""
        children = self.children + self.spine_children
        self.spine_leaves += not children
        self.spine_saved += (self.members - 1) * self.length
        if parent:
            parent.spine_children += 1
            parent.spine_leaves += self.spine_leaves
            parent.spine_saved += self.spine_saved
        return (
            self.least, self.depth, self.members, children, self.leaves + self.spine_leaves,
            self.saved + self.spine_saved, self.digest.hexdigest(), self.key, parent.key if parent else None,
        )


def _merged(batches):
    """One walk over all spines, in order: nodes that several shards hold come together."""
    names = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key", "parent_key"]
    types = [*[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary()]
    way, before = [], b""

    def rows(closed):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*closed), types, strict=True)], names)

    for batch in batches:
        closed = []
        for row in batch.to_pylist():
            common = shared_turns(before, row["turns"]) if way else -1
            while len(way) > common + 1:
                node = way.pop()
                closed.append(node.close(way[-1] if way else None))
            keys = spine_keys(row["turns"])
            for depth in range(len(way), len(keys)):
                way.append(Merged(keys[depth], depth, row["length"][depth]))
            known = (row[k] for k in ("members", "least", "leaves", "children", "saved", "ends"))
            for depth, values in enumerate(zip(*known, strict=True), row["start"]):
                way[depth].add(*values)
            before = row["turns"]
        if closed:
            yield rows(closed)
    closed = []
    while way:
        node = way.pop()
        closed.append(node.close(way[-1] if way else None))
    if closed:
        yield rows(closed)


def digested(conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(conv_id, turns): for each conversation its turns' (digest, length in code points), in order."""
    rows = only(conversations, **{conv_id: "bigint", turn: "bigint", role: "string", text: "string"})
    rows = rows.toDF("conv_id", "turn", "role", "text").where("conv_id is not null").na.fill("", ["role", "text"])
    named = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    digest = F.substring(F.sha2(named, 256), 1, 2 * WIDTH)
    slim = rows.select("conv_id", F.struct("turn", digest.alias("digest"), F.length("text").cast("bigint").alias("length")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"], t["length"]))
    return slim.groupBy("conv_id").agg(turns.alias("turns"))


def regrown(conversations: DataFrame, group: int, most: int, taken: Column) -> DataFrame:
    """(conv_id, turns), as `digested`, with the first turns of each exchanged.

    The first `taken`, at most `most`, are those of the conversation c - c % group, if there is one.
    """
    base = conversations.where(F.col("conv_id") % group == 0)
    base = base.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_first"))
    taken = taken.cast("int")
    both = conversations.join(base, F.col("conv_id") - F.col("conv_id") % group == F.col("_base"), "left")
    first = F.when(F.col("_first").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("_first", F.lit(1), taken))
    rest = F.slice("turns", taken + 1, F.greatest(F.size("turns") - taken, F.lit(0)))
    return both.select("conv_id", F.concat(first, rest).alias("turns"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row a node, of (conv_id, turns) as `digested` gives them.

    conv_id: the smallest member; depth; parent_conv_id; n_convs: members; n_children; n_leaves and
    saved_tokens of the subtree; ends_sha256: of the ids of conversations that end here.
    """
    keys = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    lengths = F.transform("turns", lambda t: t["length"])
    rows = materialise(turns.select("conv_id", keys.alias("keys"), lengths.alias("lengths")))
    ordered = rows.repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    found = materialise(ordered.mapInArrow(_shards, f"{NODE}, parent_key binary, spine struct<{SPINE}>"))
    names = [field.split()[0] for field in NODE.split(", ")]
    spines = found.where("spine is not null").select("spine.*")
    spines = spines.repartition(1).sortWithinPartitions("part", "block", "side").drop("part", "block", "side")
    merged = materialise(
        spines.mapInArrow(_merged, f"{NODE.replace('parent_conv_id bigint, ', '')}, key binary, parent_key binary")
    )
    finished = found.where("spine is null and parent_key is null").select(*names)
    open_nodes = found.where("parent_key is not null").drop("spine", "parent_conv_id").unionByName(merged.drop("key"))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return finished.unionByName(open_nodes.join(parents, "parent_key", "left").select(*names))
