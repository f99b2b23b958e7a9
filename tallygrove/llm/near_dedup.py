"""Near-dedup by word shingles: SimHash links and MinHash bands find pairs, an exact Jaccard similarity
verifies them.

A text's set holds the hashes of its shingles of five words; two texts link at a Jaccard similarity
of 0.8 or more, and of each component of links one row stays. Equal sets are one node from the
start, so exact copies and repeated rows cost no pairs.

Fingerprints of the shingles are linked by the BK-trees of `simhash`, and each node is first judged with
the smallest node of its fingerprint's component. Four of 64 bits is about a similarity of 0.95, so pairs
farther apart are found by bands.

`BANDS` bands of `BAND_ROWS` rows miss a pair at 0.8 with a probability of (1 - 0.8 ** 5) ** 32,
about 3e-6, and pairs above it with less. Nodes that share a band are its bucket, and a node weighs
the sum of the sizes of its buckets, which is largest for a text that many are near to. Where links don't join them yet, each
node is compared with one other, the heaviest that leads one of its buckets, then with the leaders
of all its buckets, unless links join them already. What is still apart in a bucket is compared in
pairs, but for those that can't be near: a node shares at most the shingles that any other such
node has, and two nodes at most the smaller such number. Of nodes with a possible partner a sketch
of `SKETCH` bits is made, each the parity of one minimum: at a similarity s, bits differ with a
probability of (1 - s) / 2. Only pairs with no more differing bits than one at the threshold has, plus
`DEVIATIONS` standard deviations, are judged by their sets; a near pair is lost here with a
probability of about 1e-6. A group of copies is joined by a pair a node, and nodes of one bucket
that are clearly apart are told so by their sketches, inside the join. Sets are moved only for
compared nodes.

Words are what stands between ASCII white space, A-Z lower-cased. A text of fewer words than a
shingle is one shingle; null, empty and blank texts have the empty set and are one node, which is
near to nothing else. The row with the smallest id of a component stays, a null id comes last. An
empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm import simhash
from tallygrove.llm.common import numbered, released, utf8
from tallygrove.llm.simhash import BROADCAST_ROWS, SEED, components
from tallygrove.session import materialise

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 32
BAND_ROWS = 5
ROUNDING = 1e-6
BLOCK = 1 << 11  # shingles that meet all rows at once
BROADCAST_CALLS = 200_000  # about 20 MB
LOT = 1000  # nodes compared with a leader in one task
SENT_BYTES = 8 << 20  # of sets in a batch
SKETCH = 1024  # bits
DEVIATIONS = 5

_draw = np.random.default_rng(SEED)
FACTORS, SHIFTS, MIXERS = (_draw.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) | np.uint64(1) for _ in range(3))
_draw = np.random.default_rng(SEED + 1)
SKETCH_FACTORS, SKETCH_SHIFTS, SKETCH_MIXERS = (
    _draw.integers(0, 1 << 64, SKETCH, np.uint64) | np.uint64(1) for _ in range(3)
)
WORDS = [f"s{k}" for k in range(SKETCH // 64)]  # columns of a sketch


def shingles(text: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    hashed = xxhash.xxh64_intdigest
    found = {hashed(b" ".join(words[k : k + size]), SEED) for k in range(max(1, len(words) - size + 1))}
    return np.sort(np.fromiter(found, "<u8", len(found)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; no bands of an empty set."""
    if not len(hashes):
        return np.zeros(0, "<u8")
    return _minima(hashes, FACTORS, SHIFTS, MIXERS, BLOCK).reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64)


def _minima(hashes, factors, shifts, mixers, block):
    """The least value of a set by each function, mixed so that all its bits tell."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), block):
        np.minimum(least, (hashes[at : at + block, None] * factors + shifts).min(axis=0), out=least)
    return (least ^ least >> np.uint64(31)) * mixers


def sketch(hashes: np.ndarray) -> np.ndarray:
    """`SKETCH` bits of a set, as words of 64."""
    mixed = _minima(hashes, SKETCH_FACTORS, SKETCH_SHIFTS, SKETCH_MIXERS, BLOCK >> 3)
    return np.packbits((mixed >> np.uint64(63)).astype(np.uint8)).view("<i8")


def most_differing(threshold: float) -> int:
    """The number of bits in which two sketches may differ for their sets to be judged."""
    differ = (1 - threshold) / 2
    return int(SKETCH * differ + DEVIATIONS * (SKETCH * differ * (1 - differ)) ** 0.5)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets, given in order."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def _marked(rows: DataFrame, text: str, size: int) -> DataFrame:
    """All columns of `rows` with `fingerprint`, `_set` and `_bands`."""

    def marks(texts):
        digests, keys = [], []
        for data in texts:
            found = shingles(data, size)
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            keys.append(bands(found).view("<i8"))
        return pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))

    return simhash.with_fingerprints(rows, text, size, marks, _set="binary", _bands="array<bigint>")


def _similar(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Those of the distinct (node, leader) pairs whose sets are near; `texts` are (node, text).

    A set goes once to each leader it is compared with, and the leader's own set comes first there,
    so a task holds one leader's set and lets the others pass. A leader of more than `LOT` nodes
    has its set copied to as many parts as it has such lots.
    """

    def sets(batches):
        for batch in released(batches):
            out, held = [], 0
            for text, calls in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = shingles(text, size).tobytes()
                for call in calls:
                    out.append((call["leader"], call["part"], call["node"], found))
                    held += len(found)
                    if held > SENT_BYTES:
                        yield as_batch(out)
                        out, held = [], 0
            yield as_batch(out)

    def as_batch(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        arrays = [pa.array(list(column), kind) for column, kind in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["leader", "part", "node", "hashes"])

    def near(batches):
        at, first = None, None
        for batch in released(batches):
            leaders, parts, nodes = (batch.column(k).to_pylist() for k in range(3))
            found = []
            for leader, part, node, hashes in zip(leaders, parts, nodes, batch.column(3), strict=True):
                hashes = np.frombuffer(hashes.as_buffer(), "<u8")
                if at != (leader, part):
                    at, first = (leader, part), hashes.copy()
                elif similarity(hashes, first) >= threshold:
                    found.append((max(node, leader), min(node, leader)))
            found = np.array(found, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / LOT).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    members = pairs.join(parts, "leader").select("node", "leader", part.alias("part"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    first = parts.select(F.col("leader").alias("node"), "leader", every.alias("part"))
    calls = members.union(first).groupBy("node").agg(F.collect_list(F.struct("leader", "part", "node")).alias("calls"))
    calls = materialise(calls)
    if (calls.agg(F.sum(F.size("calls"))).first()[0] or 0) <= BROADCAST_CALLS:
        calls = F.broadcast(calls)
    sent = texts.join(calls, "node").select("text", "calls").mapInArrow(
        sets, "leader bigint, part int, node bigint, hashes binary"
    )
    dealt = sent.repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("node") != F.col("leader"))
    return materialise(dealt.mapInArrow(near, "a bigint, b bigint"))


def _leaders(left: DataFrame) -> DataFrame:
    """(key, leader, leader_root, leader_rank): the heaviest node of each bucket."""
    best = F.max(F.struct("weight", (-F.col("node")).alias("last"), "root")).alias("best")
    rank = F.struct("best.weight", "best.last").alias("leader_rank")
    best = left.groupBy("key").agg(best)
    return best.select("key", (-F.col("best.last")).alias("leader"), F.col("best.root").alias("leader_root"), rank)


def _open(left: DataFrame, joined: DataFrame) -> DataFrame:
    """The nodes of each bucket with their present roots; buckets whose nodes are all joined go."""
    now = left.drop("root").join(joined.toDF("node", "root"), "node", "left")
    now = now.withColumn("root", F.coalesce("root", "node"))
    ends = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    return materialise(now.join(ends.select("key"), "key", "left_semi"))


def _sketched(nodes: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node, shingles, common, s0, …) of the nodes that may have a partner.

    `shingles` is the size of a node's set, `common` how many of them another node has, too.
    """

    def sketches(batches):
        for batch in released(batches):
            hashes = batch.column(3).flatten().to_numpy().view("<u8")
            stops = np.cumsum(batch.column(1).to_numpy())
            found = [sketch(x) for x in np.split(hashes, stops[:-1])] if len(stops) else []
            columns = np.array(found, "<i8").reshape(-1, len(WORDS)).T
            arrays = [*batch.columns[:3], *map(pa.array, columns)]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "shingles", "common", *WORDS])

    def sets(batches):
        for batch in released(batches):
            found = [shingles(text, size).view("<i8") for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "hashes"]
            )

    held = texts.join(nodes, "node").select("node", "text").mapInArrow(sets, "node bigint, hashes array<bigint>")
    held = materialise(held)
    once = held.select("node", F.explode("hashes").alias("hash")).groupBy("hash")
    once = once.agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    once = once.groupBy("node").agg(F.count("*").alias("own"))
    sized = held.select("node", F.size("hashes").alias("shingles")).join(once, "node", "left")
    common = F.col("shingles") - F.coalesce("own", F.lit(0))
    sized = sized.select("node", "shingles", common.alias("common"))
    sized = sized.where(F.col("common") >= threshold * F.col("shingles") - ROUNDING)
    with_sets = sized.join(held, "node").where("shingles > 0").select("node", "shingles", "common", "hashes")
    words = ", ".join(f"{word} bigint" for word in WORDS)
    return materialise(with_sets.mapInArrow(sketches, f"node bigint, shingles int, common bigint, {words}"))


def _linked(nodes: DataFrame) -> DataFrame:
    """(node, leader): each node of (node, fingerprint) with the smallest of its SimHash component."""
    values = materialise(nodes.select("fingerprint").distinct())
    roots = components(simhash.near_links(values)).toDF("fingerprint", "root")
    rooted = nodes.join(roots, "fingerprint", "left").select("node", F.coalesce("root", "fingerprint").alias("root"))
    rooted = materialise(rooted)
    leaders = rooted.groupBy("root").agg(F.min("node").alias("leader"))
    return materialise(rooted.join(leaders, "root").where("node != leader").select("node", "leader"))


def near_links(
    nodes: DataFrame, texts: DataFrame, size: int, threshold: float, linked: DataFrame | None = None
) -> DataFrame:
    """(a, b), as `components` gives them: what the near ones of all pairs of a shared band join, and
    those of the pairs `linked`, which are judged first."""
    listed = nodes.select("node", F.explode("bands").alias("key"))
    buckets = listed.groupBy("key").agg(F.count("*").alias("nodes")).where("nodes > 1")
    shared = materialise(listed.join(buckets, "key"))
    weights = shared.groupBy("node").agg(F.sum("nodes").alias("weight"))
    left = shared.join(weights, "node").select("key", "node", "weight", F.col("node").alias("root"))
    left = materialise(left)
    judged, known = [], None
    if linked is not None:
        judged, known = [linked], components(_similar(linked, texts, size, threshold))
        left = _open(left, known)
    # Each node with the best of its leaders: one pair a node.
    met = left.join(_leaders(left), "key").where("root != leader_root")
    first = materialise(met.groupBy("node").agg((-F.max("leader_rank")["last"]).alias("leader")))
    near = _similar(first, texts, size, threshold)
    joined = components(near if known is None else known.union(near))
    # With the leaders of all its buckets, where still apart.
    left = _open(left, joined)
    leaders = materialise(_leaders(left))
    met = left.join(leaders, "key").where("root != leader_root").select("node", "leader").distinct()
    second = materialise(met.join(first, ["node", "leader"], "left_anti"))
    joined = components(joined.union(_similar(second, texts, size, threshold)))
    # What is still apart in a bucket, without the leader that has met all of it.
    done = leaders.select("key", F.col("leader").alias("node"))
    left = _open(left.join(done, ["key", "node"], "left_anti"), joined)
    left = materialise(left.join(_sketched(left.select("node").distinct(), texts, size, threshold), "node"))
    names = {name: f"other_{name}" for name in ("node", "root", "shingles", "common", *WORDS)}
    others = left.select("key", *(F.col(name).alias(other) for name, other in names.items()))
    most = F.least("common", "other_common")
    might = most >= threshold * (F.col("shingles") + F.col("other_shingles") - most) - ROUNDING
    differing = sum(F.bit_count(F.col(word).bitwiseXOR(F.col(f"other_{word}"))) for word in WORDS)
    third = left.join(others, "key").where("root < other_root").where(might).where(differing <= most_differing(threshold))
    third = third.select("node", F.col("other_node").alias("leader")).distinct()
    for done in (*judged, first, second):
        for pair in (["node", "leader"], ["leader", "node"]):
            third = third.join(done.select(*pair).toDF("node", "leader"), ["node", "leader"], "left_anti")
    return components(joined.union(_similar(materialise(third), texts, size, threshold)))


def drop_near_duplicates(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE_WORDS,
    threshold: float = SIMILARITY,
) -> DataFrame:
    """The rows of `documents`, one for each component: the one with the smallest id.

    The rows are written once with a number each. The numbers of rows that go are broadcast within
    `BROADCAST_ROWS`, else joined.
    """
    names = documents.columns
    key, text = (f"c{names.index(name)}" for name in (doc_id, text))
    rows = _marked(numbered(documents), text, size)
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()))
    fingerprint = F.min("fingerprint").alias("fingerprint")  # repeats of a shingle count, so a set may have several
    nodes = rows.groupBy("_set").agg(F.min("_row").alias("node"), F.first("_bands").alias("bands"), fingerprint)
    nodes = materialise(nodes)
    texts = rows.select(F.col("_row").alias("node"), F.col(text).cast("string").alias("text"))
    linked = _linked(nodes.select("node", "fingerprint"))
    joined = near_links(nodes, texts, size, threshold, linked).toDF("node", "root")
    rooted = nodes.select("_set", "node").join(joined, "node", "left").select("_set", F.coalesce("root", "node").alias("root"))
    marked = rows.select(F.col(key).cast("bigint").alias("doc_id"), "_set", "_row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    stay = marked.join(rooted, "_set").groupBy("root").agg(F.min(order)["_row"].alias("_row"))
    gone = materialise(marked.select("_row").join(stay.select("_row"), "_row", "left_anti"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, "_row", "left_anti").drop("_row", "_set", "_bands", "fingerprint").toDF(*names)
