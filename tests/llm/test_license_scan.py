"""License scans against the exact containment in every window."""

import re

import pytest

from tallygrove.llm import license_scan as ls


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def shingles(tokens):
    return [tuple(tokens[k : k + 5]) for k in range(len(tokens) - 4)]


def expected(text, templates):
    out = set()
    own = shingles(words(text))
    for name, template in templates:
        wanted = set(shingles(words(template)))
        size = 1
        while size < len(wanted):
            size *= 2
        shares = [
            (len(wanted & set(own[at : at + 2 * size])) / len(wanted), at) for at in range(0, max(1, len(own)), size)
        ]
        good = [(s, at) for s, at in shares if s >= 0.8]
        if good:
            best = min(good, key=lambda x: (-x[0], x[1]))
            out.add((name, best[0], best[1], len(good)))
    return out


def scanned(spark, texts, templates):
    schema = "doc_id bigint, text string, license_id int, row int, w string, size int"
    documents = spark.createDataFrame([(n, t, 1, 2, "x", 3) for n, t in enumerate(texts)], schema)
    table = spark.createDataFrame(templates, "license_id string, text string")
    found = ls.scan(documents, table)
    assert found.columns == ["doc_id", "license_id", "containment", "first_word", "windows"]
    out = {}
    for r in found.collect():
        out.setdefault(r["doc_id"], set()).add((r["license_id"], r["containment"], r["first_word"], r["windows"]))
    return out


def test_against_every_window(spark):
    notices = sorted(ls.NOTICES.items())
    filler = " ".join(f"word{k}" for k in range(150))
    texts = [f"{filler}\n{text.upper()}; {filler}" for _, text in notices]
    texts += [" ".join(t for _, t in notices), f"{notices[0][1]} " * 3, None, "", "only four words here", "é" * 9]
    for _, text in notices:  # a word in the middle is another, one is left out, the end is cut
        tokens = text.split()
        middle = len(tokens) // 2
        texts += [" ".join([*tokens[:middle], "other", *tokens[middle + 1 :]]), " ".join(tokens[: max(5, len(tokens) * 9 // 10)])]
    texts.append("long text " * 30_000 + notices[1][1])
    found = scanned(spark, texts, notices)
    for n, text in enumerate(texts):
        assert found.get(n, set()) == expected(text, notices), n


def test_bands_hit_at_the_least_similarity():
    # The documented bound: shares of 0.8 at the worst size of template.
    for size in (2, 4, 8, 16, 32, 64, 128):
        least = size // 2 + 1
        assert (1 - 0.8 * least / (2 * size + 0.2 * least)) ** ls.BANDS < 2e-6


def test_templates(spark):
    documents = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    schema = "license_id string, text string"
    for bad in ([("x", "a b c d")], [("x", ""), ("y", "a b c d e f")]):
        with pytest.raises(ValueError, match="words"):
            ls.scan(documents, spark.createDataFrame(bad, schema))
    assert ls.scan(documents, spark.createDataFrame([], schema)).count() == 0
    some = spark.createDataFrame([("x", "A, b c-d e"), (None, "a b c d e"), ("z", None)], schema)
    assert [r["license_id"] for r in ls.scan(documents, some).collect()] == ["x"]
    assert ls.scan(documents.limit(0), some).count() == 0


def test_repeated_rows(spark):
    documents = spark.createDataFrame([(1, "x a b c d e"), (1, "x a b c d e"), (None, "a b c d e")], "doc_id bigint, text string")
    found = ls.scan(documents, spark.createDataFrame([("l", "a b c d e")], "license_id string, text string"))
    assert sorted(str(r["doc_id"]) for r in found.collect()) == ["1", "1", "None"]


def test_no_python_in_the_plan(spark):
    from tallygrove.llm.queries import QUERIES

    plan = QUERIES["op3_license_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
