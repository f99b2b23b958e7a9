"""The numbered queries: each applies an operator, with production parameters, to a whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from tallygrove.llm import chat, decontaminate, fingerprint, html_text, lexical, license_scan, line_dedup
from tallygrove.llm import neighbours, pack, quality, simhash, toxicity, trie
from tallygrove.llm.common import crc, drawn_rows, only, read


def op1_quality(spark, sf_dir):
    """A quality score of every document; a quarter of the ids is never learnt from."""
    documents = only(read(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    labels = read(spark, sf_dir, "labels")
    held_out = F.coalesce(crc() % 4 == 2, F.lit(False))
    training = drawn_rows(documents, labels, "quality", ~held_out, quality.TRAIN_ROWS_PER_CLASS)
    scored = quality.score(documents, quality.fit(training), out="score")
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op2_packing(spark, sf_dir):
    """The pieces of all documents in sequences of at most 2048 tokens."""
    documents = only(read(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    pieces = pack.pack(documents, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_license_scan(spark, sf_dir):
    """License notices in each document."""
    documents = only(read(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    return license_scan.scan(documents, license_scan.notices(spark))


def op4_simhash(spark, sf_dir):
    """Each document's fingerprint and the smallest id of the documents it is linked with."""
    documents = only(read(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    found = simhash.near_duplicates(documents)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def op5_line_dedup(spark, sf_dir):
    """Lines of keys found in ten documents or more go from every document."""
    documents = only(read(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    cleaned = line_dedup.dedup_lines(documents, min_docs=10, min_chars=1, keep_first=False)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_chat_formatting(spark, sf_dir):
    """Canonical turns of every conversation, from raw transcripts without their role column.

    Probabilities are counted over the conversations whose crc32(conv_id) mod 4 is not 2.
    """
    raw = chat.transcripts(read(spark, sf_dir, "conversations"))
    held_out = F.coalesce(crc("conv_id") % 4 == 2, F.lit(False))
    model = chat.fit(raw.where(~held_out))
    return chat.parse(raw.drop("role"), model).withColumn("held_out", held_out)


def op7_decontamination(spark, sf_dir):
    """Words of each document inside windows of benchmark items."""
    documents = only(read(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    found = decontaminate.with_matches(documents, read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op8_toxicity(spark, sf_dir):
    """A toxicity score of every document; a third of the ids is never learnt from."""
    documents = only(read(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    labels = read(spark, sf_dir, "labels")
    held_out = F.coalesce(crc() % 3 == 1, F.lit(False))
    training = drawn_rows(documents, labels, "toxic", ~held_out, toxicity.TRAIN_ROWS_PER_CLASS)
    scored = toxicity.score(documents, toxicity.fit(training), out="score")
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op9_neighbours(spark, sf_dir):
    """The five nearest rows to every fiftieth vector."""
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_html_extraction(spark, sf_dir):
    """The visible text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages"))


def op11_prefix_trie(spark, sf_dir):
    """The nodes of the prefix trie of all conversations, after turns were borrowed within hundreds."""
    conversations = trie.digested(read(spark, sf_dir, "conversations"))
    return trie.prefix_trie(trie.regrown(conversations, 100, 5, crc("conv_id") % 6))


def op12_fingerprints(spark, sf_dir):
    """Every document's fingerprint beside those of its edited text and of the next document."""
    return fingerprint.compare_edits(read(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    documents = only(read(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    return lexical.search(documents, read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_license_scan": op3_license_scan,
    "op4_simhash": op4_simhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_neighbours": op9_neighbours,
    "op10_html_extraction": op10_html_extraction,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fingerprints": op12_fingerprints,
    "op13_lexical_search": op13_lexical_search,
}

