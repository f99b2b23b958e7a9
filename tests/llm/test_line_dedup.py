"""Line dedup against a plain count of all lines."""

import hashlib
import random
from collections import Counter

import pytest

from tallygrove.llm import line_dedup

WHITE = " \t\n\r\x0b\x0c"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def expected(rows, min_docs, min_chars, keep_first):
    """(n_lines, n_dropped, text) of each row, by counting all keys."""
    counts, first = Counter(), {}
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if k and len(k) >= min_chars:
                counts[k] += 1
                if doc is not None:
                    first[k] = min(doc, first.get(k, doc))
    out = []
    for doc, text in rows:
        kept, seen, lines = [], set(), (text or "").split("\n")
        for line in lines:
            k = key(line)
            if counts[k] >= min_docs:
                if not keep_first or first.get(k) != doc or k in seen:
                    continue
                seen.add(k)
            kept.append(line)
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def random_rows(seed, n=120):
    draw = random.Random(seed)
    pool = ["Alpha beta", " alpha BETA\t", "É", "é", "x", "", "  ", "long line " * 20, "\x0bq\x0c", "q", " q", "ß"]
    rows = [(draw.choice([i, i, i, 7, None]), "\n".join(draw.choices(pool, k=draw.randint(0, 6)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "\n".join(f"row {i}" for i in range(20_000)))]
    return rows + rows[:3]


@pytest.mark.parametrize("broadcast_keys", [10**6, 0])
@pytest.mark.parametrize("min_docs, min_chars, keep_first", [(10, 1, False), (2, 1, True), (3, 5, True), (1, 2, False)])
def test_against_all_lines(spark, broadcast_keys, min_docs, min_chars, keep_first):
    rows = random_rows(min_docs)
    schema = "doc_id bigint, text string, n_lines string, _doc int, digest int"
    data = spark.createDataFrame([(*r, "x", n, n) for n, r in enumerate(rows)], schema).repartition(7)
    found = line_dedup.dedup_lines(
        data, min_docs=min_docs, min_chars=min_chars, keep_first=keep_first, bits=16, broadcast_keys=broadcast_keys
    )
    assert found.columns == ["doc_id", "text", "_doc", "digest", "n_lines", "n_dropped"]
    got = {r["_doc"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in found.collect()}
    assert got == dict(enumerate(expected(rows, min_docs, min_chars, keep_first)))


def test_a_full_filter_changes_nothing(spark):
    rows = random_rows(5)
    data = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = [
        sorted((r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(data, min_docs=3, bits=bits).collect())
        for bits in (8, 20)
    ]
    assert found[0] == found[1]


def test_filters_hold_what_was_seen_twice(spark):
    shared = [f"shared {i}" for i in range(500)]
    rows = [(i, "\n".join(shared[i * 10 : i * 10 + 20] + [f"own {i} {k}" for k in range(20)])) for i in range(50)]
    data = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    bitmap = line_dedup.twice_seen(data, "text", 1, 20)

    def suspected(line):
        digest = hashlib.blake2b(line.encode(), digest_size=16).digest()
        return bool(line_dedup.holds(bitmap, line_dedup.positions(line_dedup.as_numbers([digest]), 20))[0])

    assert all(suspected(line) for line in shared[10:490])
    assert sum(suspected(f"own {i} {k}") for i in range(50) for k in range(20)) < 20


def test_rows_of_one_id_do_not_share_their_keys(spark, monkeypatch):
    """Beyond the broadcast, the keys that go to a row are its own, whatever its id."""
    sizes = []

    def written(df, materialise=line_dedup.materialise):
        df = materialise(df)
        if "_row" in df.columns:
            keys = line_dedup.keys_by_row(df.select("_row", "c1"), repeated, 1)
            sizes.extend(r[0] for r in keys.selectExpr("size(_keys)").collect())
        return df

    rows = [(draw, "\n".join(f"line {draw} {n} {k}" for k in range(3))) for draw in (None, 7) for n in [*range(40), *range(40)]]
    data = spark.createDataFrame(rows, "doc_id bigint, text string")
    repeated = line_dedup.materialise(line_dedup.repeated_keys(data, "doc_id", "text", 2, 1, 16))
    monkeypatch.setattr(line_dedup, "materialise", written)
    found = line_dedup.dedup_lines(data, bits=16, broadcast_keys=0)
    assert sorted(r["text"] for r in found.collect()) == sorted(text for _, _, text in expected(rows, 2, 1, True))
    assert sizes == [3] * len(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_dedup.dedup_lines(empty).collect() == []
