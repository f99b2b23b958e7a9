"""SimHash near-dedup: fingerprints, linked by BK-trees of small shards, joined to components.

A fingerprint's bit is set if it is set in more than half of the hashes of the text's shingles.
Fingerprints link at `RADIUS` or fewer differing bits.

All fingerprints together have no size bound, so their trees never go through the driver. Two
fingerprints within the radius agree on at least one of radius + 1 disjoint blocks of bits. So
each block's value names a shard: every distinct fingerprint is sent by the shuffle to one shard
for each block, where a BK-tree (children keyed by their Hamming distance to the parent) is built
and searched along edges within the radius only. No link is lost. Larger tables use more,
narrower blocks of which several must agree, so a shard stays small; a shard that holds more than
`HOT_SHARD` fingerprints all the same is dealt anew by blocks of its remaining bits, which is as
exact. A tree passes by what is linked already, and a shard returns one link a fingerprint, so a
group of thousands costs no pairs. Links meet in rounds of star contraction, each a written
table.

Words are what stands between ASCII white space, A-Z lower-cased. A text of fewer words than a
shingle is one shingle; null, empty and blank texts have fingerprint zero, which links like any
other. Exact copies and repeated rows are one fingerprint from the start. A component is named
after its smallest id; null ids count only where all are null. An empty table gives an empty result.
"""

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import extended, numbered, only, released, utf8
from tallygrove.session import materialise

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
BITS = 64
SHARD_SIZE = 256  # fingerprints in a shard, if they were spread evenly
HOT_SHARD = 20_000
BROADCAST_ROWS = 1_000_000  # 8 MB of row numbers
LEVELS = 3  # how often a hot shard is dealt anew


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends[: -size or None])][: max(1, len(words) - size + 1)]
    hashed = xxhash.xxh64_intdigest
    last = ends[size - 1 :] or ends[-1:]
    hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, last)], "<u8")
    counts = np.zeros(BITS, np.int64)
    for block in range(0, len(hashes), 1 << 14):
        part = hashes[block : block + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(
    documents: DataFrame, text: str = "text", size: int = SHINGLE_WORDS, marks=None, **added
) -> DataFrame:
    """All columns of `documents` and `fingerprint`, the 64 bits as a bigint. No shuffle.

    What else a caller makes of the texts goes in the same pass, as a second one would hold a second
    Python worker a core: `added` names and types such columns, `marks` gives them for a list of texts.
    """
    documents = documents.drop("fingerprint", *added)
    place = documents.columns.index(text)
    rows = numbered(documents)
    schema = extended(rows, fingerprint="bigint", **added)

    def marked(batches):
        for batch in released(batches):
            texts = utf8(batch.column(place))
            found = np.array([fingerprint(x, size) for x in texts], "<u8")
            more = marks(texts) if marks else ()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view("<i8")), *more], schema.names)

    return rows.mapInArrow(marked, schema).toDF(*documents.columns, "fingerprint", *added)


class BKTree:
    """Fingerprints of one shard, each linked to the ones within the radius as it comes in."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values, self.children, self.parent, self.uniform = [], [], [], []

    def root(self, node: int) -> int:
        """What names the node's component."""
        while self.parent[node] != node:
            self.parent[node] = node = self.parent[self.parent[node]]
        return node

    def add(self, value: int) -> None:
        new, radius = len(self.values), self.radius
        values, children, uniform = self.values, self.children, self.uniform
        values.append(value)
        children.append({})
        self.parent.append(new)
        uniform.append(True)  # all below is in the node's own component
        if not new:
            return
        stack = [0]
        while stack:
            node = stack.pop()
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                a, b = self.root(node), self.root(new)
                self.parent[max(a, b)] = min(a, b)
            for edge, child in children[node].items():
                if distance - radius <= edge <= distance + radius:
                    if not (uniform[child] and self.root(child) == self.root(new)):
                        stack.append(child)
        node, mine = 0, self.root(new)
        while True:
            if uniform[node] and self.root(node) != mine:
                uniform[node] = False
            edge = (values[node] ^ value).bit_count()
            if edge not in children[node]:
                children[node][edge] = new
                return
            node = children[node][edge]

    def links(self) -> list:
        """(fingerprint, first fingerprint of its component) for all that are not the first."""
        pairs = [(node, self.root(node)) for node in range(len(self.values))]
        return [(self.values[a], self.values[b]) for a, b in pairs if a != b]


def blocks_of(mask: int, n: int) -> list:
    """The bits that `mask` leaves out, as n disjoint blocks of about equal width."""
    free = [1 << bit for bit in range(BITS) if not mask >> bit & 1]
    return [sum(free[k * len(free) // n : (k + 1) * len(free) // n]) for k in range(n)]


def first_masks(fingerprints: int, radius: int) -> list:
    """Masks such that any two fingerprints within the radius agree under one of them.

    Of `n` blocks at least n - radius agree. The least n whose shards are small is taken.
    """
    n = radius + 1
    while n < BITS // 4 and fingerprints >> (BITS // n * (n - radius)) > SHARD_SIZE:
        n += 1
    return [sum(blocks) for blocks in combinations(blocks_of(0, n), n - radius)]


def signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def shard_keys(fingerprints: DataFrame, radius: int) -> DataFrame:
    """(mask, value, fingerprint): the shards of each fingerprint."""
    masks = first_masks(fingerprints.count(), radius)
    value = F.col("fingerprint").bitwiseAND(F.col("mask")).alias("value")
    keys = fingerprints.select("fingerprint", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    keys = keys.select("mask", value, "fingerprint")
    for _ in range(LEVELS):
        hot = materialise(keys.groupBy("mask", "value").count().where(F.col("count") > HOT_SHARD).drop("count"))
        if hot.isEmpty():
            break
        # As many hot shards as fingerprints / HOT_SHARD at most for a mask: a join, no broadcast asked for.
        finer = {m: [m | b for b in blocks_of(m, radius + 1)] for m in masks if m != (1 << BITS) - 1}
        lists = F.create_map(
            *[x for m, fs in finer.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(f)) for f in fs]))]
        )
        marked = keys.join(hot.withColumn("hot", F.lit(True)), ["mask", "value"], "left")
        choice = F.when(F.col("hot"), F.coalesce(lists[F.col("mask")], F.array("mask"))).otherwise(F.array("mask"))
        keys = materialise(marked.select("fingerprint", F.explode(choice).alias("mask")).select("mask", value, "fingerprint"))
        masks = sorted({*masks, *(f for fs in finer.values() for f in fs)})
    return keys


def near_links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links, with a > b, that join just those components that all links would join."""

    def linked(batches):
        key, held = None, []
        for batch in batches:
            mask, value, fingerprint = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(mask):
                continue
            turns = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
            pairs = []
            for start, end in zip([0, *turns.tolist()], [*turns.tolist(), len(mask)], strict=True):
                if key != (mask[start], value[start]):
                    pairs += searched(held)
                    key, held = (mask[start], value[start]), []
                held.append(fingerprint[start:end])
            yield as_batch(pairs)
        yield as_batch(searched(held))

    def searched(parts):
        if sum(map(len, parts)) < 2:
            return []
        tree = BKTree(radius)
        for value in np.concatenate(parts).view("<u8").tolist():
            tree.add(value)
        return tree.links()

    def as_batch(pairs):
        found = np.array(pairs, "<u8").reshape(-1, 2).view("<i8")
        return pa.RecordBatch.from_arrays([pa.array(found.max(axis=1)), pa.array(found.min(axis=1))], ["a", "b"])

    keys = shard_keys(fingerprints, radius)
    shards = keys.repartition("mask", "value").sortWithinPartitions("mask", "value", "fingerprint")
    return shards.mapInArrow(linked, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): each linked node that isn't the smallest of its component, and that smallest node.

    Rounds of large-star and small-star contraction until nothing changes; a round is a table.
    """

    def state(edges):
        return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    edges = materialise(links)
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        edges = edges.join(least, "b").select("a", F.col("m").alias("b")).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a")
        edges = least.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = materialise(edges.where("a != b").distinct())
        after = state(edges)
        if after == before:
            return edges
        before = after
    return edges


def named_fingerprints(marked: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, root, component_id) of (doc_id, fingerprint) rows; a root stands for a component."""
    nodes = materialise(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    edges = components(near_links(nodes.select("fingerprint"), radius))
    members = edges.union(edges.select("b", "b").distinct()).toDF("fingerprint", "root")
    linked = materialise(members.join(nodes, "fingerprint"))
    names = linked.groupBy("root").agg(F.min("first").alias("name"))
    names = linked.join(names, "root").select("fingerprint", "root", "name")
    return nodes.join(names, "fingerprint", "left").select(
        "fingerprint",
        F.coalesce("root", "fingerprint").alias("root"),
        F.coalesce("name", "first").alias("component_id"),
    )


def near_duplicates(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of `documents`."""
    texts = only(documents, **{doc_id: "bigint", text: "string"}).toDF("doc_id", "text")
    marked = materialise(with_fingerprints(texts, size=size).drop("text"))
    named = named_fingerprints(marked, radius).select("fingerprint", "component_id")
    return marked.join(named, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def drop_near_duplicates(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """The rows of `documents`, one for each component: the one with the smallest id.

    Repeated rows are copies of each other, so one stays; a null id comes last. The rows are
    written once with a number each. The numbers of rows that go are broadcast within
    `BROADCAST_ROWS`, else joined.
    """
    names = documents.columns
    key, text = (f"c{names.index(name)}" for name in (doc_id, text))
    rows = with_fingerprints(numbered(documents), text, size)
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()))
    marked = rows.select(F.col(key).cast("bigint").alias("doc_id"), "fingerprint", "_row")
    rooted = marked.join(named_fingerprints(marked, radius).select("fingerprint", "root"), "fingerprint")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    stay = rooted.groupBy("root").agg(F.min(order)["_row"].alias("_row"))
    gone = materialise(marked.select("_row").join(stay.select("_row"), "_row", "left_anti"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, "_row", "left_anti").drop("_row", "fingerprint").toDF(*names)
