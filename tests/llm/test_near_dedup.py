"""Near duplicates by five-word shingles against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallygrove.llm import near_dedup
from tallygrove.llm.simhash import components


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def kept(rows):
    """The row of the smallest id of each component, by all pairs; null ids last."""
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if near(sets[a], sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    best = {}
    for n, row in enumerate(rows):
        best[top(n)] = min(best.get(top(n), row), row, key=lambda r: (r[0] is None, r[0] or 0))
    return best.values()


def edited(draw, text, share):
    words = text.split()
    for at in draw.sample(range(len(words)), max(1, round(share * len(words)))):
        words[at] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def rows_of(seed):
    draw = random.Random(seed)
    base = [" ".join(draw.choices([f"w{i}" for i in range(400)], k=draw.randint(30, 300))) for _ in range(25)]
    texts = [*base, *(edited(draw, t, share) for t in base for share in (0.005, 0.015, 0.03, 0.1))]
    chain = base[0]
    for _ in range(6):
        chain = edited(draw, chain, 0.015)
        texts.append(chain)
    texts += [None, "", " \n", "one", "one", "One two", "long " * 50_000, base[1].upper()]
    rows = [(n, t, 1, "x") for n, t in enumerate(texts)]
    draw.shuffle(rows)
    return rows + [rows[0], (None, base[2], 1, "x"), (None, "alone " * 9, 1, "x")]


@pytest.mark.parametrize("seed, sent", [(1, 10**6), (2, 0)])
def test_one_of_each_component_stays(spark, monkeypatch, seed, sent):
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", sent)
    rows = rows_of(seed)
    table = spark.createDataFrame(rows, "doc_id bigint, text string, _row int, c0 string").repartition(3)
    found = near_dedup.drop_near_duplicates(table)
    assert found.columns == table.columns
    assert sorted(r["doc_id"] or -1 for r in found.collect()) == sorted(r[0] or -1 for r in kept(rows))


def test_what_a_leader_does_not_link_is_compared(spark):
    """One bucket for all: the pairs that its smallest node has no part in are found, too."""
    texts = list({frozenset(shingles(r[1])): r[1] for r in rows_of(3) if (r[1] or "").split()}.values())
    table = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    nodes = table.select("node", F.array(F.lit(7)).alias("bands"))
    found = components(near_dedup.near_links(nodes, table, 5, 0.8))
    gone = {r["a"] for r in found.collect()}
    assert set(range(len(texts))) - gone == {r[0] for r in kept([(n, t) for n, t in enumerate(texts)])}


def test_bands_find_pairs_at_the_threshold():
    draw = np.random.default_rng(3)
    missed = 0
    for _ in range(2000):
        pool = draw.integers(0, 1 << 64, 20, np.uint64)
        a, b = np.sort(pool[:18]), np.sort(pool[2:])  # 16 of 20
        missed += not set(near_dedup.bands(a).tolist()) & set(near_dedup.bands(b).tolist())
    assert missed <= 1


def test_sketches_keep_near_pairs_and_part_others():
    draw = np.random.default_rng(5)
    bound = near_dedup.most_differing(0.8)

    def differing(shared, own):
        pool = draw.integers(0, 1 << 64, shared + 2 * own, np.uint64)
        a, b = (near_dedup.sketch(np.sort(x)) for x in (pool[: shared + own], pool[own:]))
        return sum(int(x).bit_count() for x in (a ^ b).view("<u8"))

    for shared, own in ((16, 2), (80, 10), (800, 100)):
        assert max(differing(shared, own) for _ in range(200)) <= bound
    assert min(differing(120, 40) for _ in range(200)) > bound  # a similarity of 0.6


def test_stage_drops_copies_at_0_8(spark):
    """Copies with a tenth of the shingles changed are more than four bits apart, and near all the same."""
    draw = random.Random(9)
    base = [" ".join(draw.choices([f"w{i}" for i in range(400)], k=200)) for _ in range(20)]
    texts = [*base, *(edited(draw, t, 0.015) for t in base)]
    docs = spark.createDataFrame([(n, t, "en", "s", len(t)) for n, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert all(near(shingles(a), shingles(b)) for a, b in zip(base, texts[20:], strict=True))
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == list(range(20))


def test_fingerprints_find_pairs_of_their_own(spark, monkeypatch):
    """Without a shared band, near copies whose fingerprints link go all the same, others never."""
    draw = random.Random(4)
    base = [" ".join(draw.choices([f"w{i}" for i in range(400)], k=900)) for _ in range(8)]
    texts = [*base, *(edited(draw, t, 0.0012) for t in base), "x " + "one two " * 9, "y " + "two one " * 400]
    values = [near_dedup.simhash.fingerprint(t.encode(), 5) for t in texts]
    linked = [n for n in range(8) if (values[n] ^ values[n + 8]).bit_count() <= 4]
    assert len(linked) > 3
    monkeypatch.setattr(near_dedup, "bands", lambda hashes: hashes[:1])
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    judged = []
    monkeypatch.setattr(near_dedup, "_similar", lambda pairs, *a, f=near_dedup._similar: judged.append(pairs) or f(pairs, *a))
    found = {r["doc_id"] for r in near_dedup.drop_near_duplicates(table).collect()}
    assert judged[0].count() >= len(linked)
    assert not found & {n + 8 for n in linked} and found >= {*range(8), 16, 17}


def test_empty_table(spark):
    assert near_dedup.drop_near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
