import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallygrove.functions import text as scalar
from tallygrove.functions.globs import glob_to_regex, globs_to_regex
from tallygrove.functions.pieces import SPECIAL_TOKENS, piece_count, pieces
from tallygrove.operators.path_rules import matches

# The public split pattern, for an independent engine.
PATTERN = (
    r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}"
    r"| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)

TEXTS = [
    "Hello, world!",
    "a  \n\n b",
    "x.\n \n y",
    "  z",
    "\u00a0\u00a0z",
    "\u2003\u00a0 \u2003x\u00a0\n\u00a0y",
    "  \t",
    "don'T we'LL you'Re I'M",
    "1234567 12 3",
    "  !!\r\n\r\n x",
    "ſ 's 'ſ",
    "　\n　x",
    "a\u0085b\u0085 c",
    "été naïve é́ 日本語テキスト 🙂🙂 ½ Ⅷ",
    "tabs\t\tand   spaces   ",
    "<|not special|> <| x |>",
    "  lead\n\n\n  trail  \n",
    "",
]


def split(text):
    """Segments between specials are split one by one, specials are pieces."""
    out = []
    for part in regex.split("(" + "|".join(map(regex.escape, SPECIAL_TOKENS)) + ")", text):
        out += [part] if part in SPECIAL_TOKENS else regex.findall(PATTERN, part)
    return out


def test_pieces(rows):
    table = rows([(t,) for t in TEXTS], "text string")
    for row in table.select("text", pieces(F.col("text")).alias("p")).collect():
        assert row["p"] == split(row["text"]), row["text"]


ALPHABET = "ab Z'sStTlLrReEvVmMdD09½Ⅷé́\u017f\u00a0\u2003\u3000\u0085\u200b\t\n\r.!<|>語🙂\u0000\u0001$\\"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(ALPHABET, max_size=40), min_size=40, max_size=40))
def test_random_pieces(rows, texts):
    table = rows([(t,) for t in texts], "text string")
    text = F.col("text")
    for row in table.select(text, pieces(text).alias("p"), piece_count(text).alias("n")).collect():
        assert row["p"] == regex.findall(PATTERN, row["text"]), row["text"]
        assert row["n"] == len(row["p"])


@pytest.mark.parametrize("special", SPECIAL_TOKENS)
def test_special_tokens_end_the_text_before_them(rows, special):
    texts = [f"a{special}b", special, f"x  {special}  y", f"!!{special}!!", f"\n{special}\n"]
    texts += [f"{special}{special}", f"<{special}>", f" \t{special}'s", f"a <|{special}|> b"]
    table = rows([(t,) for t in texts], "text string")
    found = table.select("text", pieces(F.col("text")).alias("p"), piece_count(F.col("text")).alias("n"))
    for row in found.collect():
        assert row["p"] == split(row["text"]), row["text"]
        assert row["n"] == len(row["p"])


@pytest.mark.parametrize(
    "text, blank",
    [("", True), (" \t\n", True), ("\u00a0", True), ("\u2003", True), ("\u0085", True)]
    + [("\u200b", False), (" a ", False), ("\n.\n", False)],
)
def test_blank(rows, text, blank):
    assert rows([(text,)], "t string").select(scalar.is_blank(F.col("t"))).first()[0] is blank


def test_scalars(rows):
    one = rows([("/r/a/b", -5)], "path string, n bigint")
    path = F.col("path")
    assert one.select(scalar.relative_path(path, "/r")).first()[0] == "a/b"
    assert one.select(scalar.relative_path(path, "/r/")).first()[0] == "a/b"
    assert one.select(scalar.relative_path(path, "/ra")).first()[0] == "/r/a/b"
    assert one.select(scalar.path_components(path)).first()[0] == ["", "r", "a", "b"]
    before = F.timestamp_seconds("n")
    assert one.select(scalar.version_seconds(before)).first()[0] == 0
    assert one.select(scalar.version_seconds(F.timestamp_seconds(F.lit(7.9)))).first()[0] == 7
    for size, mb in [(0, 0.0), (524_288, 1.0), (524_287, 0.0), (1_572_864, 2.0)]:
        assert one.select(scalar.whole_mb(F.lit(size))).first()[0] == mb
    assert one.select(scalar.left_cell(F.lit("é"), F.lit(4))).first()[0] == "é  "
    assert one.select(scalar.right_cell(F.lit(12))).first()[0] == "      12"
    assert one.select(scalar.right_cell(F.lit(123456789))).first()[0] == "123456789"


GLOBS = [
    ("*.rs", ["test.rs", "src/test.rs"], ["test.js", "rs"]),
    ("src/**/*.txt", ["src/foo/bar.txt", "src/bar.txt"], ["bar.txt", "xsrc/a.txt"]),
    ("**/*.rs", ["a.rs", "b/c/a.rs"], ["a.rsx"]),
    ("**", ["a", "a/b", ".x"], []),
    ("node_modules/", [], ["node_modules/a", "node_modules"]),
    ("node_modules/**", ["node_modules/a/b", "node_modules/a"], ["node_modules", "x/node_modules/a"]),
    ("*.{rs,md}", ["x.md", "x.rs"], ["x.rm"]),
    ("{a,b{c,d}}.x", ["a.x", "bc.x", "bd.x"], ["b.x", "ac.x"]),
    ("[!a].c", ["b.c"], ["a.c", "bb.c"]),
    ("[a-c]?", ["az", "c/"], ["dz", "a"]),
    ("[]-]x", [], []),
    (r"\*\[", ["*["], ["a["]),
    ("a.b", ["a.b"], ["axb", "A.b"]),
    ("a,b", ["a,b"], ["a"]),
    ("é*+(|)^$", ["é!+(|)^$"], ["e+(|)^$"]),
    (".git/**", [".git/config"], ["a.git/config"]),
    ("**/.hid", [".hid", "a/.hid"], ["a.hid"]),
]


@pytest.mark.parametrize("pattern, yes, no", GLOBS)
def test_globs(rows, pattern, yes, no):
    table = rows([(p, p in yes) for p in yes + no] or [("x", False)], "path string, want boolean")
    for row in table.select("path", "want", matches(F.col("path"), [pattern]).alias("got")).collect():
        assert row["got"] == row["want"], (pattern, row["path"])


@pytest.mark.parametrize("pattern", ["[", "[]", "[z-a]", "{a", "a}", "[!]", "x\\"])
def test_bad_globs_are_named(pattern):
    with pytest.raises(ValueError) as failure:
        glob_to_regex(pattern)
    assert f"'{pattern}'" in str(failure.value)


def test_no_pattern_matches_nothing(rows):
    assert globs_to_regex([]) is None
    assert rows([("a",)], "path string").where(matches(F.col("path"), [])).count() == 0
