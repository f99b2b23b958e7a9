"""Fingerprints and components against all pairs."""

import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrove.llm import simhash

WHITE = " \t\n\r\x0b\x0c"


def fingerprint(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < size else [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(values, radius):
    """Smallest position of each one's component, by all pairs."""
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(values))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "x y", "\x1c", " "]), max_size=30), st.sampled_from([" ", "\n", " \t\x0b "]))
def test_fingerprint(words, blank):
    assert simhash.fingerprint(blank.join(words).encode()) == fingerprint(blank.join(words))


def test_fingerprint_of_many_blocks():
    text = " ".join(f"w{i * i % 977}" for i in range(40_000))
    assert simhash.fingerprint(text.encode()) == fingerprint(text)


def near_values(seed, n):
    """Clusters around centres, chains and lone values."""
    draw = random.Random(seed)
    values = [draw.getrandbits(64) for _ in range(n // 4)]
    while len(values) < n:
        value = draw.choice(values[-20:] + values[:5])
        for _ in range(draw.randint(0, 6)):
            value ^= 1 << draw.randrange(64)
        values.append(value)
    return list(dict.fromkeys(values))


@pytest.mark.parametrize("seed", range(5))
def test_tree(seed):
    values, radius = near_values(seed, 200), 4
    tree = simhash.BKTree(radius)
    for value in values:
        tree.add(value)
    assert [tree.root(node) for node in range(len(values))] == groups(values, radius)


def test_masks_miss_no_pair():
    draw = random.Random(3)
    for count, radius in [(10, 4), (10**7, 4), (10**10, 4), (10**6, 2)]:
        masks = simhash.first_masks(count, radius)
        for _ in range(300):
            change = sum(1 << bit for bit in draw.sample(range(64), radius))
            assert any(not change & mask for mask in masks)


@pytest.mark.parametrize("hot", [20_000, 5])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_SHARD", hot)
    values, radius = near_values(11, 300), 4
    table = spark.createDataFrame([(simhash.signed(v),) for v in values], "fingerprint bigint")
    found = simhash.components(simhash.near_links(table, radius))
    names = {r["a"]: r["b"] for r in found.collect()}
    got = [names.get(simhash.signed(v), simhash.signed(v)) for v in values]
    expected = groups(values, radius)
    assert len(set(got)) == len(set(expected))
    assert len(set(zip(got, expected, strict=True))) == len(set(got))


def test_a_long_chain(spark):
    edges = [(i + 1, i) for i in range(200)]
    found = simhash.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {(r["a"], r["b"]) for r in found.collect()} == {(i, 0) for i in range(1, 201)}


def table(spark):
    draw = random.Random(5)
    base = [" ".join(draw.choices([f"w{i}" for i in range(300)], k=400)) for _ in range(12)]
    texts = [*base, *base[:4], *(b.replace("w7 ", "q ", 1) for b in base), None, "", " \n", "one", "one", "a b c d"]
    texts.append("long " * 100_000)
    rows = [(n, t, 1, 2, "x") for n, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base[1], 1, 2, "x"), (None, "alone " * 9, 1, 2, "x"), (None, "alone " * 9, 1, 2, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint int, _row int, c0 string"), rows


def test_near_duplicates(spark):
    documents, rows = table(spark)
    found = simhash.near_duplicates(documents.drop("fingerprint"))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    values = [fingerprint(r[1]) for r in rows]
    roots = groups(values, 4)
    least = {}
    for row, root in zip(rows, roots, strict=True):
        if row[0] is not None:
            least[root] = min(row[0], least.get(root, row[0]))
    expected = [(r[0], simhash.signed(v), least.get(root)) for r, v, root in zip(rows, values, roots, strict=True)]
    key = str
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("rows_sent", [10**6, 0])
def test_one_of_each_group_stays(spark, monkeypatch, rows_sent):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", rows_sent)
    documents, rows = table(spark)
    kept = simhash.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    roots = groups([fingerprint(r[1]) for r in rows], 4)
    first = {}
    for row, root in zip(rows, roots, strict=True):
        best = first.get(root)
        if best is None or (row[0] is not None and (best[0] is None or row[0] < best[0])):
            first[root] = row
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, first.values()))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.drop_near_duplicates(empty).collect() == []
