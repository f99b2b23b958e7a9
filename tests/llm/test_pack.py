"""Packing: exact round trips, and cuts against a search over all ways to cut."""

import random
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallygrove.llm import pack

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "it's 'twas I'M'LL", "á b́", "ＡＢ ½ ²x", "<|endoftext|>x <|startoftext|>", "x\x0by\x0cz\x1cq\x85r\xa0s t",
    "İstanbul ΣΑΣ ǅ", "a_b__c 12a3 #!?'", "日本語 テスト", "​ ﻿", "", " ", "\n\n", "ª º µ ß SS ẞ", "éx",
    "don’t", "l'société", "x́̂ ́", "ÀÖØß×÷", "٣٤ Ⅷ", "🙂🙂 a🙂b", "a<b|c>d...?!", "tab\tand\r\nend.",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_tokenizer(tokenizer, monkeypatch):
    encoder = pack.PieceEncoder(PATH)
    assert encoder.by_part
    draw = random.Random(1)
    marks = [*"abzABÉß09.,!?'<>|_-\n\t ", "́", "\xa0", "é"]
    texts = ODD + ["".join(draw.choices(marks, k=draw.randint(1, 40))) for _ in range(3000)]
    monkeypatch.setattr(pack, "MEMO", 50)  # old words go now and then
    for batch in (texts[k : k + 7] for k in range(0, len(texts), 7)):
        for text, ids in zip(batch, encoder.encode(batch), strict=True):
            wanted = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, encoder.kind).tolist() == wanted, repr(text)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = pack.PieceEncoder(path), Tokenizer.from_file(path)
    assert not encoder.by_part
    text = "Whole texts, with  blanks.\n"
    assert np.frombuffer(encoder.encode([text])[0], encoder.kind).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(40))
def test_cuts_cost_least(seed):
    draw, length = random.Random(seed), 8
    places = np.array(sorted(draw.sample(range(1, 60), 25)))
    places = np.unique(np.append(places, np.arange(5, 60, 7)))
    costs = np.array([draw.choice([0, 0, 2, 5]) for _ in places])

    @cache
    def best(j):
        if j < 0:
            return 0
        options = []
        for i in range(-1, j):
            size = places[j] - (places[i] if i >= 0 else 0)
            if size <= length:
                options.append(best(i) + (0 if size & (size - 1) == 0 else length - size) + costs[j])
        return min(options)

    cuts = pack.best_cuts(places, costs, length)
    at = {int(p): c for p, c in zip(places, costs, strict=True)}
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == places[-1] and max(sizes) <= length
    found = sum((0 if s & (s - 1) == 0 else length - s) + at[c] for s, c in zip(sizes.tolist(), cuts, strict=True))
    assert found == best(len(places) - 1)


@pytest.mark.parametrize("block, shard_rows", [(pack.BLOCK, 20_000), (100, 10)])
def test_round_trip(spark, tokenizer, monkeypatch, block, shard_rows):
    monkeypatch.setattr(pack, "BLOCK", block)
    monkeypatch.setattr(pack, "SHARD_ROWS", shard_rows)
    draw = random.Random(2)
    words = ["the", "of", "end.", "Why?", "x1", "\n"]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 150))) for _ in range(60)] + ODD
    texts += [None, "", "word " * 6000, "done. " * 3000]
    rows = [(n, t, 1, "x") for n, t in enumerate(texts)] + [(None, "no id", 1, "x"), (0, texts[0], 1, "x")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, start int, ids string")
    length = 64
    pieces = pack.pack(documents, PATH, length=length).collect()
    sequences, by_document = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        by_document[p["doc_id"]].append((p["start"], ids, p["doc_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    expected = defaultdict(list)
    for doc, text, *_ in rows:
        expected[doc].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    assert set(by_document) == set(expected)
    for doc, wanted in expected.items():
        parts = sorted(by_document[doc])
        if len(wanted) == 1:
            assert [i for _, ids, _ in parts for i in ids] == wanted[0]
            assert {total for *_, total in parts} == {len(wanted[0])}
        else:
            assert sum(len(ids) for _, ids, _ in parts) == sum(map(len, wanted))
    sizes = [sum(size for _, size in parts) for parts in sequences.values()]
    padding = sum(0 if s & (s - 1) == 0 else length - s for s in sizes)
    assert padding <= 0.1 * sum(sizes)


def test_empty_table(spark):
    assert pack.pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []
