"""Fingerprints against sums over single paragraphs, edits against slices of Python strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import fingerprint as f
from tallygrove.llm.fingerprint import Fingerprint, likeness

PARTS = ["", "a", "é中", "x" * 15, "y" * 16, "Ein Satz mit Wörtern. ", "the same words again and again ", "😀" * 9, "0123456789abcdef0"]


def random_text(draw, most=12):
    return "\n".join(draw.choice(PARTS) * draw.randint(1, 3) for _ in range(draw.randint(0, most)))


def naive_counts(text, block):
    counts = np.zeros(f.LIKENESS, np.int64)
    for paragraph in text.split(b"\n"):
        starts = range(len(paragraph) - f.RUN + 1) if len(paragraph) >= f.RUN else range(bool(paragraph))
        seen = {(k // block, paragraph[k : k + f.RUN].ljust(f.RUN, b"\0")) for k in starts}
        for _, run in seen:
            words = np.frombuffer(run, "<u8")
            counts += f._placed(f._mixed(words[:1], words[1:]))
    return counts.astype(np.uint32)


@pytest.mark.parametrize("block", [5, 16, 1 << 18])
def test_runs(monkeypatch, block):
    monkeypatch.setattr(f, "BLOCK", block)
    draw = random.Random(block)
    for _ in range(60):
        text = random_text(draw).encode()
        assert (f.run_counts(text) == naive_counts(text, block)).all()


def test_homomorphism():
    draw = random.Random(1)
    for _ in range(80):
        paragraphs = random_text(draw).split("\n")
        whole = Fingerprint.of("\n".join(paragraphs).encode())
        shuffled = draw.sample(paragraphs, len(paragraphs))
        total = Fingerprint()
        for paragraph in shuffled:
            total = total + Fingerprint.of(paragraph.encode())
        assert total == whole and str(total) == str(whole)
        assert Fingerprint.of("\n".join(shuffled).encode()) == whole
        assert whole - Fingerprint.of(paragraphs[0].encode()) + Fingerprint.of(paragraphs[0].encode()) == whole
        assert Fingerprint.parse(str(whole)) == whole


def test_unequal_texts():
    draw = random.Random(2)
    seen = {}
    for _ in range(3000):
        text = random_text(draw)
        key = tuple(sorted(text.split("\n")))
        assert seen.setdefault(str(Fingerprint.of(text.encode())), key) == key


def test_likeness():
    draw = random.Random(3)
    words = ["w%d" % k for k in range(5000)]

    def text(n):
        return [" ".join(draw.choices(words, k=25)) for _ in range(n)]

    for share in (0.25, 0.5, 0.75, 0.9):
        for _ in range(20):
            a = text(40)
            b = a[: int(40 * share)] + text(40 - int(40 * share))
            x, y = (Fingerprint.of("\n".join(t).encode()) for t in (a, draw.sample(b, 40)))
            assert abs(likeness(x, y) - share) < 0.25
            assert likeness(x, y) == likeness(y, x)
    assert likeness(x, x) == 1.0
    empty = Fingerprint.of(b"")
    assert likeness(empty, empty) == 1.0 and likeness(empty, x) == 0.0 == likeness(empty, Fingerprint.of(b"\n"))


def expected(rows):
    """(doc_id, n_chars, edited text, text, next text) of rows in order."""
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        count = len(text) // 4
        yield doc, len(text), text[: len(text) - count] + after[:count], text, after


@pytest.mark.parametrize("seed", range(6))
def test_compare_edits(spark, monkeypatch, seed):
    draw = random.Random(seed)
    monkeypatch.setattr(f, "PART_BYTES", [1, 300, 1 << 20][seed % 3])
    monkeypatch.setattr(f, "SAMPLES", [1, 100][seed % 2])
    rows = [(k * 7 - 100, random_text(draw)) for k in range(draw.choice([1, 2, 60]))]
    if seed % 2:
        rows += [(5000, "same"), (5000, "same"), (9000, None), (9001, "z" * 3000)]
    docs = spark.createDataFrame([(*r, "x") for r in draw.sample(rows, len(rows))], "doc_id bigint, text string, part string")
    found = sorted(f.compare_edits(docs.repartition(3)).collect(), key=lambda r: (r["doc_id"], r["edited_sha256"]))
    wanted = expected(sorted((d, t or "") for d, t in rows))
    wanted = [(d, n, hashlib.sha256(e.encode()).hexdigest(), *map(lambda t: Fingerprint.of(t.encode()), (t, e, a))) for d, n, e, t, a in wanted]
    wanted.sort(key=lambda w: w[0:3:2])
    assert len(found) == len(wanted)
    for row, (doc, n, digest, own, edited, after) in zip(found, wanted):
        assert tuple(row)[:5] == (doc, n, digest, str(own), str(edited))
        assert (row["near_edited"], row["near_next"]) == (likeness(own, edited), likeness(own, after))


def test_equal_and_null_ids(spark):
    """A third of the rows with one id, a third without: ordered by a hash of the text."""
    rows = [(None if k % 3 == 0 else 1 if k % 3 == 1 else k, f"text {k} " * 5) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ties = docs.withColumn("tie", F.xxhash64("text")).orderBy(F.asc_nulls_last("doc_id"), "tie").collect()
    wanted = {(d, n, hashlib.sha256(e.encode()).hexdigest()) for d, n, e, *_ in expected([(r[0], r[1]) for r in ties])}
    assert {tuple(r)[:3] for r in f.compare_edits(docs).collect()} == wanted and len(wanted) == 90


def test_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb", "old"), (2, None, "x")], "id int, body string, fingerprint string")
    marked = f.with_fingerprints(docs, text="body")
    assert marked.columns == ["id", "body", "fingerprint"]
    assert [r["fingerprint"] for r in marked.orderBy("id").collect()] == [str(Fingerprint.of(b"a\nb")), str(Fingerprint.of(b""))]
    moved = marked.select(f.changed("fingerprint", F.array(F.lit("c")), F.array(F.lit("a"))).alias("c")).collect()
    assert moved[0]["c"] == str(Fingerprint.of(b"b\nc"))
    assert f.compare_edits(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
