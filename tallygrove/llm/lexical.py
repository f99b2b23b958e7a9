"""Ranked lexical search by a dual tree: items and documents in hierarchies of coordinate maxima.

A document is a vector with a coordinate for each term of the items, an item one with the weights
of its terms; a score is their product. A node of either hierarchy holds, coordinate by coordinate,
the largest value below it, so the product of two nodes bounds the scores of all pairs below them.
A pair of nodes whose bound stays under the weakest k-th score of the node's items is left with all
it holds; what is left over at the leaves is scored exactly. Nothing else is dropped, so the
result is exact.

Every task reads a stream of documents, in shards of at most `SHARD_DOCS` documents and
`SHARD_POSTINGS` coordinates, each with a tree of its own; the k-th scores go on from shard to shard. A
task returns its k best documents of an item, of which the k best of all are chosen by one more
shuffle.

Items are a stated query set: they come to the driver in blocks of at most `ITEM_TERMS` terms, and
documents pass once for each block. Document counts of terms, the number of documents and of terms
cover all documents. Only coordinates of the items' terms are written, never texts.

Terms are runs of code points other than ASCII punctuation, space and controls, A-Z lower-cased.
Null and empty texts have no terms and no rank. Items of an equal id, null included, are one item
with the terms of all. Every row of `documents` is a document: repeated rows rank one after the
other; equal scores go by ascending id, null last. Empty tables give an empty result.
"""

from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.llm.common import only, utf8
from tallygrove.llm.decontaminate import words
from tallygrove.session import materialise

BEST = 10
ITEM_TERMS = 200_000  # of one block of items
SHARD_DOCS = 4096
SHARD_POSTINGS = 1 << 20
FAN = 4  # children of a document node
ITEM_FAN = 4
CHUNK = 16  # document nodes that meet an item between two looks at its k-th score


def term_weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at `starts`, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Level:
    """The nodes of one level: sparse vectors on end, `at` says where each begins."""

    def __init__(self, at, terms, values):
        self.at, self.terms, self.values = at, terms, values

    def __len__(self):
        return len(self.at) - 1

    def maxima(self, fan: int) -> "Level":
        """The level above: the largest value a coordinate has in each `fan` nodes."""
        node = np.repeat(np.arange(len(self)) // fan, np.diff(self.at))
        order = np.lexsort((self.terms, node))
        node, terms, values = node[order], self.terms[order], self.values[order]
        first = np.flatnonzero(np.diff(node, prepend=-1) | np.diff(terms, prepend=-1))
        at = np.searchsorted(node[first], np.arange(-(-len(self) // fan) + 1))
        largest = np.maximum.reduceat(values, first) if len(first) else values
        return Level(at, terms[first], largest)

    def products(self, nodes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The product of each of `nodes` with the dense vector `weights`."""
        sizes = self.at[nodes + 1] - self.at[nodes]
        places = ranges(self.at[nodes], sizes)
        sums = np.append(0, np.cumsum(weights[self.terms[places]] * self.values[places]))
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]


class ItemTree:
    """Items by their heaviest terms; a node is the (terms, items) below it, its children and height."""

    def __init__(self, items: list, weights: np.ndarray, fan: int = ITEM_FAN):
        self.weights = weights
        heavy = [sorted(terms, key=lambda t: (-weights[t], t))[:3] for terms in items]
        order = sorted(range(len(items)), key=lambda i: (heavy[i], i))
        nodes, height = [(np.array(sorted(items[i]), np.int64), [i], [], 0) for i in order], 0
        while len(nodes) > 1:
            height += 1
            groups = [nodes[k : k + fan] for k in range(0, len(nodes), fan)]
            joined = [(np.unique(np.concatenate([n[0] for n in g])), sum((n[1] for n in g), [])) for g in groups]
            nodes = [(*both, g, height) for both, g in zip(joined, groups, strict=True)]
        self.root = nodes[0] if nodes else None


class DualTree:
    """The best documents of each item over the shards given to `search`."""

    def __init__(self, items: list, weights: np.ndarray, best: int = BEST):
        self.tree, self.best = ItemTree(items, weights), best
        self.weights, self.dense = weights, np.zeros(len(weights), np.int64)
        none = np.zeros(0, np.int64)
        self.found = [(none, none, none) for _ in items]  # scores, null ids, ids: highest first
        self.kth = np.ones(len(items), np.int64)  # a score below it has no place
        self.scored = 0  # pairs that were scored

    def search(self, ids: list, at: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        """Documents `ids` with the vectors (terms, values), which begin at `at`."""
        if not len(terms) or self.tree.root is None:
            return
        # Documents with the same strongest coordinate become neighbours, so maxima stay low.
        strength = self.weights[terms] * values
        filled = np.flatnonzero(np.diff(at))
        top = np.maximum.reduceat(strength, at[filled])
        owner = np.repeat(np.arange(len(filled)), np.diff(at)[filled])
        strongest = np.full(len(filled), -1)
        hits = np.flatnonzero(strength == top[owner])
        strongest[owner[hits][::-1]] = terms[hits][::-1]
        order = filled[np.lexsort((-top, strongest))]
        sizes = np.diff(at)[order]
        places = ranges(at[order], sizes)
        self.ids = [ids[k] for k in order]
        self.levels = [Level(np.append(0, np.cumsum(sizes)), terms[places], values[places])]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].maxima(FAN))
        self._visit(self.tree.root, len(self.levels) - 1, np.zeros(1, np.int64))

    def _products(self, item, level, nodes):
        terms = item[0]
        self.dense[terms] = self.weights[terms]
        bounds = self.levels[level].products(nodes, self.dense)
        self.dense[terms] = 0
        return bounds

    def _below(self, level, nodes):
        """The children of document nodes."""
        ends = np.minimum((nodes + 1) * FAN, len(self.levels[level - 1]))
        return ranges(nodes * FAN, ends - nodes * FAN)

    def _visit(self, item, level, nodes):
        """The pairs of an item node with document nodes of one level."""
        bounds = self._products(item, level, nodes)
        if not item[2] and level == 0:
            self._score(item[1][0], nodes, bounds)
            return
        kept = bounds >= self.kth[item[1]].min()
        nodes, bounds = nodes[kept], bounds[kept]
        if not len(nodes):
            return
        if item[2]:
            # The taller of the two nodes is opened, so that items are apart before documents are.
            if level > item[3]:
                level, nodes = level - 1, self._below(level, nodes)
            for child in item[2]:
                self._visit(child, level, nodes)
        elif level > 1:
            self._visit(item, level - 1, self._below(level, nodes))
        else:
            # The most promising first, so that the k-th score rises early.
            order = np.argsort(-bounds, kind="stable")
            for k in range(0, len(order), CHUNK):
                part = order[k : k + CHUNK]
                part = part[bounds[part] >= self.kth[item[1][0]]]
                if not len(part):
                    break
                self._visit(item, 0, self._below(1, nodes[part]))

    def _score(self, item, nodes, scores):
        self.scored += len(nodes)
        kept = scores >= self.kth[item]
        if not kept.any():
            return
        ids = [self.ids[k] for k in nodes[kept].tolist()]
        old = self.found[item]
        scores = np.concatenate([old[0], scores[kept]])
        nulls = np.concatenate([old[1], np.array([x is None for x in ids], np.int64)])
        ids = np.concatenate([old[2], np.array([x or 0 for x in ids], np.int64)])
        best = np.lexsort((ids, nulls, -scores))[: self.best]
        self.found[item] = scores[best], nulls[best], ids[best]
        if len(best) == self.best:
            self.kth[item] = scores[best[-1]]


def item_blocks(items: DataFrame, item_id: str, text: str, item_terms: int):
    """Lists of (item id, set of terms), of at most `item_terms` terms or of one item."""
    rows = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).distinct()
    block, size, last = [], 0, None
    for item, content in rows.orderBy("item", "text").toLocalIterator():
        terms = set(words((content or "").encode()))
        if block and block[-1][0] == item:
            block[-1][1].update(terms)
            continue
        if block and size + len(terms) > item_terms:
            yield block
            block, size = [], 0
        block.append((item, terms))
        size += len(terms)
    if block:
        yield block


def _postings(documents: DataFrame, vocabulary: dict) -> DataFrame:
    """(doc_id, n, terms, tfs): terms of a document that are in the vocabulary, by number."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches):
        known = sent.value
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in utf8(batch.column(1)):
                tokens = words(text)
                held = np.fromiter((known[t] for t in tokens if t in known), np.int32)
                number, tf = np.unique(held, return_counts=True)
                n.append(len(tokens))
                terms.append(number)
                tfs.append(tf)
            added = [pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *added], ["doc_id", "n", "terms", "tfs"])

    return documents.mapInArrow(counted, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def _best_of_block(documents: DataFrame, block: list, best: int) -> DataFrame:
    """(item, doc_id, score): k documents a task of each item of the block, by its number."""
    spark = documents.sparkSession
    vocabulary = {}
    items = [[vocabulary.setdefault(t, len(vocabulary)) for t in sorted(terms)] for _, terms in block]
    postings = materialise(_postings(documents, vocabulary))
    total = postings.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = total[0], total[1] or 0
    counted = postings.select(F.explode("terms").alias("term")).groupBy("term").count()
    weights = np.full(len(vocabulary), term_weight(n_docs, 0), np.int64)
    for term, df in counted.toLocalIterator():  # no more rows than the block has terms
        weights[term] = term_weight(n_docs, df)
    sent = spark.sparkContext.broadcast((items, weights))

    def values(n, tfs):
        m = 100 - 90 + (90 * n * n_docs) // n_terms
        return (1_000_000_000 * tfs) // (1000 * tfs + 8 * m)

    def searched(batches):
        search = DualTree(*sent.value, best)
        ids, sizes, terms, coordinates, held = [], [], [], [], 0

        def close():
            at = np.append(0, np.cumsum(np.array(sizes, np.int64)))
            search.search(ids, at, np.concatenate(terms).astype(np.int64), np.concatenate(coordinates))

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), batch.column(3), strict=True)
            for doc, n, own, tfs in rows:
                own = own.values.to_numpy()
                if not len(own):
                    continue
                ids.append(doc)
                sizes.append(len(own))
                terms.append(own)
                coordinates.append(values(n, tfs.values.to_numpy()))
                held += len(own)
                if len(ids) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                    close()
                    ids, sizes, terms, coordinates, held = [], [], [], [], 0
        if ids:
            close()
        for item, (scores, nulls, found) in enumerate(search.found):
            if len(scores):
                docs = pa.array(found, pa.int64(), mask=nulls.astype(bool))
                number = pa.array(np.full(len(scores), item), pa.int32())
                yield pa.RecordBatch.from_arrays([number, docs, pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return postings.mapInArrow(searched, "item int, doc_id bigint, score bigint")


def search(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    best: int = BEST,
    item_terms: int = ITEM_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` documents of each item with a score above 0."""
    spark = documents.sparkSession
    texts = only(documents, **{doc_id: "bigint", text: "string"}).toDF("doc_id", "text")
    kind = items.schema[item_id].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id bigint, score bigint"
    found = spark.createDataFrame([], schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for block in item_blocks(items, item_id, item_text, item_terms):
        ranked = _best_of_block(texts, block, best).withColumn("rank", F.row_number().over(order))
        names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(block)], f"item int, item_id {kind}")
        named = ranked.where(F.col("rank") <= best).join(F.broadcast(names), "item")
        found = found.unionByName(named.select("item_id", "rank", "doc_id", "score"))
    return found
