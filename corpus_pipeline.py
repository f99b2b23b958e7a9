"""The corpus pipeline: operators of `tallygrove.llm` in turn over `documents`.

A stage (spark, docs, sf_dir) -> DataFrame works on all rows its predecessor kept, and its
decisions take effect on them. Every stage but the last returns the columns of `documents`;
each stage's rows are written as Parquet and read again as the next one's `docs`.

Empty tables pass through as empty tables; rows with nulls are kept unless a stage rejects them.
"""

import public_tokenizers
from pyspark.sql import functions as F

from tallygrove.llm import decontaminate, line_dedup, near_dedup, pack, toxicity
from tallygrove.llm.common import BATCH_ROWS, drawn_rows, only, read
from tallygrove.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_SCORE = 0.7


def _documents(docs):
    # Whole texts are read: a reader's batch of Spark's own size takes tens of megabytes a task.
    docs.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))
    return docs.select(*COLUMNS)


def toxicity_stage(spark, docs, sf_dir):
    """Documents with a toxicity score of 0.7 or more go. Learnt from a bounded sample of all labels."""
    labels = read(spark, sf_dir, "labels")
    training = drawn_rows(
        read(spark, sf_dir, "documents"), labels, "toxic", F.lit(True), toxicity.TRAIN_ROWS_PER_CLASS
    )
    scored = toxicity.score(_documents(docs), toxicity.fit(training), out="_toxicity")
    return scored.where(F.col("_toxicity") < TOXIC_SCORE).select(*COLUMNS)


def line_dedup_stage(spark, docs, sf_dir):
    """Of a line in several documents only the first stays; blank and very short lines all stay."""
    cleaned = line_dedup.dedup_lines(_documents(docs), min_docs=2, min_chars=10)
    return _resized(cleaned)


def _resized(docs):
    """`n_chars` of the text as it is now; a document without text keeps a null."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_dedup_stage(spark, docs, sf_dir):
    """Of texts linked by a Jaccard similarity of 0.8 or more of five-word shingles the smallest id stays.

    SimHash fingerprints, linked by BK-trees, and MinHash bands find the pairs; each is verified."""
    return near_dedup.drop_near_duplicates(_documents(docs)).select(*COLUMNS)


def decontamination_stage(spark, docs, sf_dir):
    """Words inside benchmark windows go; so do documents of which they are more than half."""
    benchmark = read(spark, sf_dir, "benchmark")
    return _resized(decontaminate.decontaminate(_documents(docs), benchmark, most_coverage=0.5))


def packing_stage(spark, docs, sf_dir):
    """The pieces of sequences of at most 2048 tokens, with their ids."""
    return pack.pack(_documents(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # a learnt classifier and fingerprints are not SQL: tests/llm hold a brute-force version


def run(spark, sf_dir):
    """All stages over `documents`."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
