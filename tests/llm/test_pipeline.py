"""The pipeline's stages against plain Python over a small fixture, each on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallygrove.llm import line_dedup, near_dedup, simhash
from tallygrove.session import materialise
from tests.llm.test_decontaminate import expected as contaminated
from tests.llm.test_decontaminate import words
from tests.llm.test_line_dedup import expected as lines_kept
from tests.llm.test_near_dedup import kept as jaccard_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found.append(docs)
    return found


def test_one_python_worker_a_core(spark, monkeypatch):
    """No stage of a job has two Python passes, each of which would hold a worker of its own."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df)

    for module in (line_dedup, near_dedup, simhash):
        if hasattr(module, "materialise"):
            monkeypatch.setattr(module, "materialise", noted)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = noted(stage(spark, docs, SF))
    passes = [len(re.findall("InArrow|ArrowEval", part)) for plan in plans for part in plan.split("Exchange")]
    assert max(passes) == 1


def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_stages(outputs):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_dedup", "decontamination", "packing",
    ]
    for docs in outputs[1:-1]:
        assert docs.dtypes == outputs[0].dtypes
    for docs in outputs[2:-1]:
        assert docs.where("n_chars != length(text)").isEmpty()


def test_toxicity(spark, outputs):
    before, after = outputs[0], outputs[1]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = labels.join(after, "doc_id").groupBy("toxic").count().collect()
    every = labels.join(before, "doc_id").groupBy("toxic").count().collect()
    kept, every = ({r["toxic"]: r["count"] for r in rows} for rows in (kept, every))
    assert kept[0] >= 0.98 * every[0] and kept.get(1, 0) <= 0.1 * every[1]
    assert after.join(before, before.columns, "left_semi").count() == after.count()


def test_line_dedup(outputs):
    rows = sorted(texts(outputs[1]).items())
    wanted = [text for _, _, text in lines_kept(rows, 2, 10, True)]
    assert [text for _, text in sorted(texts(outputs[2]).items())] == wanted


def test_near_dedup(outputs):
    rows = sorted(texts(outputs[2]).items())
    assert set(texts(outputs[3])) == {row[0] for row in jaccard_kept(rows)}


def test_decontamination(spark, outputs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    after = texts(outputs[4])
    for doc, text in texts(outputs[3]).items():
        count, hit, _ = contaminated(text, items, 10)
        assert (doc in after) == (2 * len(hit) <= count)
        if doc in after:
            assert words(after[doc]) == [w for n, w in enumerate(words(text)) if n not in hit]
            assert hit or after[doc] == text


def test_packing(outputs):
    pieces = outputs[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("total"))
    assert pieces.where("n != total").isEmpty()
    assert pieces.count() == outputs[4].count()
    assert outputs[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_run_gives_the_last_stage(spark, outputs):
    columns = ["doc_id", "start", "length", "doc_tokens"]
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert outputs[5].select(columns).distinct().count() == outputs[5].count()


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, _row int, c1 string"
    rows = [(1, None, None, None, None, 0.1, 1, "x"), (2, "", "en", "s", 0, 0.1, 1, "x"), (None, "a b c d e f g", None, None, 1, 0.1, 1, "x")]
    rows += [(3, "long words here\n" * 50_000, "en", "s", 9, 0.1, 1, "x"), (3, "long words here\n" * 50_000, "en", "s", 9, 0.1, 1, "x")]
    docs = spark.createDataFrame(rows, schema)
    for table, left in ((docs, 3), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, SF)
            assert table.columns == corpus_pipeline.COLUMNS
        assert table.count() == left
        packed = corpus_pipeline.STAGES[-1][1](spark, table, SF)
        assert packed.select("doc_id").distinct().count() == left


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
