import base64
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.conftest import SF
from tallygrove.catalog import views
from tallygrove.functions.pieces import SPECIAL_TOKENS
from tallygrove.operators import bpe
from tallygrove.operators.bpe import merged_parts, read_vocab, with_bpe_tokens
from tallygrove.operators.measure import measure
from tallygrove.session import materialise
from tests.test_functions import PATTERN


def trained(texts, merges=400):
    """A small vocabulary: bytes, and then the commonest pairs of a few words."""
    words = [w.encode() for t in texts for w in t.split(" ")][:3000]
    parts = [[bytes([b]) for b in b" " + w] for w in words]
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 256 + merges:
        pairs = {}
        for word in parts:
            for pair in zip(word, word[1:]):
                pairs[pair] = pairs.get(pair, 0) + 1
        best = max(sorted(pairs), key=pairs.get)
        ranks[best[0] + best[1]] = len(ranks)
        for word in parts:
            i = 0
            while i < len(word) - 1:
                if (word[i], word[i + 1]) == best:
                    word[i : i + 2] = [best[0] + best[1]]
                i += 1
    return ranks


@pytest.fixture(scope="module")
def texts(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    odd = ["", " \n", "a<|endoftext|>b", "<|endoftext|>", "x " * 500, "z" * 5000, "été 日本語 🙂\n\n  x"]
    return [r["text"] for r in documents] + odd


@pytest.fixture(scope="module")
def ranks(texts):
    return trained(texts[:40])


@pytest.fixture(scope="module")
def expected(texts, ranks):
    specials = {t: 100_000 + i for i, t in enumerate(SPECIAL_TOKENS)}
    coder = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)
    return [len(coder.encode(t, allowed_special="all")) for t in texts]


@pytest.fixture(scope="module")
def files(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, content string")


@pytest.fixture(scope="module")
def vocab(spark, ranks):
    return spark.createDataFrame(list(ranks.items()), "token binary, rank int")


@pytest.mark.parametrize("bound", [{}, {"broadcast_entries": 10}, {"broadcast_bytes": 10}])
def test_equal_to_an_independent_tokenizer(files, vocab, expected, bound):
    found = with_bpe_tokens(files, vocab, **bound).select("id", "tokens").collect()
    assert [row["tokens"] for row in sorted(found)] == expected


def test_joined_pieces_are_not_shuffled(spark, vocab, ranks, monkeypatch):
    """However many texts have the same pieces, a lot is joined with an entry once."""
    joined = []
    monkeypatch.setattr(bpe, "materialise", lambda df: joined.append(materialise(df)) or joined[-1])
    files = spark.range(500).selectExpr("id", "repeat('the corpus of tokens ', 1 + cast(id % 7 as int)) as content", "map('k', id) as m")
    found = with_bpe_tokens(files, vocab, broadcast_entries=0)
    assert found.columns == ["id", "content", "m", "tokens"]
    assert sum(table.count() for table in joined) <= 4 * len(ranks)
    wanted = with_bpe_tokens(files, vocab)
    assert sorted(found.select("id", "tokens").collect()) == sorted(wanted.select("id", "tokens").collect())


def test_measure_blanks_nothing_else(files, vocab, expected, texts):
    found = {r["id"]: r for r in measure(files, vocab).collect()}
    for i, text in enumerate(texts):
        blank = not text.strip()
        assert found[i]["tokens"] == (0 if blank else expected[i])
        assert found[i]["content"] == ("" if blank else text)


def test_pieces_are_a_lower_bound(files, vocab):
    both = measure(files).withColumnRenamed("tokens", "pieces").join(
        measure(files, vocab).select("id", "tokens"), "id"
    )
    assert both.where("pieces > tokens").count() == 0


def test_vocabulary_file(spark, ranks, tmp_path):
    lines = [f"{base64.b64encode(t).decode()} {r}" for t, r in ranks.items()]
    (tmp_path / "v.tiktoken").write_text("\n".join(lines) + "\n")
    read = read_vocab(spark, str(tmp_path / "v.tiktoken"))
    assert {bytes(r["token"]): r["rank"] for r in read.collect()} == ranks


def naive_parts(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return len(parts)
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merge_equals_the_definition():
    chance = random.Random(7)
    for _ in range(300):
        ranks = {}
        while len(ranks) < 25:
            ranks.setdefault(bytes(chance.choices(b"abc", k=chance.randint(2, 5))), len(ranks))
        piece = bytes(chance.choices(b"abc", k=chance.randint(1, 30)))
        assert merged_parts(piece, ranks) == naive_parts(piece, ranks)


def test_a_very_long_piece_is_fast(ranks):
    assert 0 < merged_parts(b"ab" * 200_000, ranks) <= 400_000


def test_stand_in_vocabulary_holds_all_bytes(spark):
    vocab = views.stand_in_vocab(spark, SF)
    assert vocab.where(F.octet_length("token") == 1).count() == 256
    assert vocab.count() == vocab.select("rank").distinct().count() == vocab.select("token").distinct().count()
