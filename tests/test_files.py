import json
import os

import pytest
from pyspark.sql import functions as F

from tallygrove.operators.measure import measure
from tallygrove.operators.path_rules import (
    RuleSet,
    effective_rules,
    pick_rule_set,
    read_rule_sets,
    select_by_rule_sets,
    select_paths,
)
from tallygrove.plans import documents as plans
from tallygrove.plans.documents import Options
from tallygrove.sinks.merged import merged_blocks, write_merged_json, write_merged_text, write_tree
from tallygrove.sinks.store import ResultStore
from tallygrove.sources import file_tree
from tallygrove.sources.decode import decode_utf8
from tallygrove.sources.file_tree import list_files, read_contents, scan_visible_files
from tallygrove.sources.path_list import lookup_paths, read_path_list

FILES = {
    "src/test.rs": b"fn main() {}",
    "src/test.txt": b"some words here",
    "test.js": b"x",
    ".hid": b"hidden words",
    "_u": b"underscore",
    ".git/h": b"ref",
    "deep/a/b/c/d.txt": "été".encode(),
    "empty.txt": b"",
    "blank.txt": b" \n\t",
    "bad.txt": b"\xff\xfe",
    "bad_large.txt": b"a" * 9000 + b"\xc3",
    "odd name #1?.txt": b"odd",
}


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "root"
    for path, content in FILES.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_bytes(content)
    os.symlink(top / "test.js", top / "link.js")
    os.symlink(top / "src", top / "linked")
    os.utime(top / "test.js", (-5, -5))
    os.utime(top / ".hid", (1234.9, 1234.9))
    return str(top)


def test_listing(spark, root):
    rows = {r["path"]: r for r in list_files(spark, root).collect()}
    assert set(rows) == {f"{root}/{path}" for path in FILES}
    assert all(rows[f"{root}/{p}"]["length"] == len(c) for p, c in FILES.items())
    assert rows[f"{root}/test.js"]["mtime"] == 0
    assert rows[f"{root}/.hid"]["mtime"] == 1234


def test_listing_by_uri(spark, root):
    rows = list_files(spark, f"file://{root}").collect()
    assert {r["path"] for r in rows if "link" not in r["path"]} == {f"file://{root}/{p}" for p in FILES}
    read = read_contents(spark.createDataFrame([(f"file://{root}/.hid", 12)], "path string, length long"))
    assert bytes(read.first()["content"]) == b"hidden words"


def test_a_missing_root_is_an_error(spark, tmp_path):
    for root in (str(tmp_path / "absent"), f"file://{tmp_path}/absent"):
        with pytest.raises(FileNotFoundError, match="absent"):
            list_files(spark, root)


def test_a_file_as_root(spark, root):
    for place in (f"{root}/src/test.txt", f"file://{root}/src/test.txt"):
        listed = [r["path"] for r in list_files(spark, place).collect()]
        assert listed == [place]


def test_a_failing_directory_is_tried_again_and_then_raised(monkeypatch):
    monkeypatch.setattr(file_tree, "WAIT", 0)
    calls = []

    def entries(failures, error):
        def listed(directory):
            calls.append(directory)
            yield ("a", 1, 1, False)
            if len(calls) <= failures:
                raise error
            yield ("b", 1, 1, False)

        return listed

    for failures, error, expected in [(2, OSError("reset"), ["a", "b"]), (9, PermissionError(), ["a"])]:
        calls.clear()
        assert [e[0] for e in file_tree._tried(entries(failures, error), "d")] == expected
    calls.clear()
    with pytest.raises(OSError, match="reset"):
        list(file_tree._tried(entries(9, OSError("reset")), "d"))
    assert len(calls) == file_tree.ATTEMPTS


def test_a_file_too_long_for_a_row(spark, root, monkeypatch):
    listing = list_files(spark, root).withColumn("length", F.when(F.col("path").like("%src/test.txt"), 3 << 30).otherwise(F.col("length")))
    rows = {r["path"][len(root) + 1 :]: r for r in read_contents(listing).collect()}
    assert "more than 2147483647 bytes" in rows["src/test.txt"]["error"]
    assert sum(r["error"] is not None for r in rows.values()) == 1


def test_the_tree_of_a_list_with_repeats(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one two three")
    (tmp_path / "y.txt").write_text("one")
    listing = tmp_path / "list"
    listing.write_text(f"{tmp_path}/x.txt\n{tmp_path}/y.txt\n{tmp_path}/x.txt\n")
    lines = [r["line"] for r in plans.tree(plans.listed_files(spark, str(listing))).collect()]
    assert any("x.txt (3 tokens)" in line for line in lines)
    assert any(f"{tmp_path.name} (4 tokens)" in line for line in lines)


def test_contents(spark, root):
    gone = spark.createDataFrame([(f"{root}/gone", 5, 0)], list_files(spark, root).schema)
    listing = list_files(spark, root).unionByName(gone)
    rows = {r["path"][len(root) + 1 :]: r for r in measure(decode_utf8(read_contents(listing))).collect()}
    assert rows["gone"]["error"].startswith("Failed to read file")
    for name in ("bad.txt", "bad_large.txt"):
        assert rows[name]["error"] == "Invalid UTF-8"
    for name in ("gone", "bad.txt", "bad_large.txt", "empty.txt", "blank.txt"):
        assert (rows[name]["content"], rows[name]["tokens"]) == ("", 0)
    assert rows["empty.txt"]["error"] is None and rows["blank.txt"]["error"] is None
    assert rows["deep/a/b/c/d.txt"]["content"] == "été"
    assert rows["src/test.txt"]["tokens"] == 3
    assert rows["src/test.txt"]["mtime"] > 0


def test_large_contents_come_in_several_batches(spark, root, monkeypatch):
    monkeypatch.setattr("tallygrove.sources.file_tree.BYTES_PER_BATCH", 10)
    rows = read_contents(list_files(spark, root), tasks=1).collect()
    assert {r["path"][len(root) + 1 :]: bytes(r["content"]) for r in rows} == FILES


def test_visible_files(spark, root):
    rows = scan_visible_files(spark, root).collect()
    shown = {p for p in FILES if not any(part[0] in "._" for part in p.split("/"))}
    assert shown - {"empty.txt"} <= {r["path"][len(root) + 1 :] for r in rows}
    assert not any(os.path.basename(r["path"])[0] in "._" for r in rows)


@pytest.mark.parametrize("few", [True, False])
def test_path_list(spark, root, tmp_path, monkeypatch, few):
    monkeypatch.setattr("tallygrove.sources.path_list.is_small", lambda keys: few)
    monkeypatch.setattr("tallygrove.operators.skew.TASK_ROWS", 2)
    names = ["src/test.txt", "", " \t", "missing.txt", "src/test.txt", " test.js", ".hid"]
    (tmp_path / "list").write_text("\n".join(f"{root}/{n}" if n.strip() else n for n in names))
    listed = read_path_list(spark, str(tmp_path / "list"))
    found = lookup_paths(listed, decode_utf8(read_contents(list_files(spark, root))))
    rows = [(r["path"][len(root) + 1 :], r["content"], r["error"]) for r in found.orderBy("pos").collect()]
    assert rows == [
        ("src/test.txt", "some words here", None),
        ("missing.txt", None, "Failed to read file"),
        ("src/test.txt", "some words here", None),
        (" test.js", None, "Failed to read file"),
        (".hid", "hidden words", None),
    ]


def names(root, frame):
    return {r["path"][len(root) + 1 :] for r in frame.collect()}


def test_select_files(spark, root):
    only = Options(include=["**/*.rs"], ignore=["test.js"])
    assert names(root, plans.select_files(spark, root, only)) == {"src/test.rs"}
    with open(f"{root}/.gitignore", "w") as rules:
        rules.write("*.txt\n!blank.txt\ndeep/\n")
    with open(f"{root}/src/.ignore", "w") as rules:
        rules.write("!test.txt\n")
    chosen = names(root, plans.select_files(spark, root, Options(ignore=[".git/**", "**/.*ignore"])))
    assert chosen == {"src/test.rs", "src/test.txt", "test.js", ".hid", "_u", "blank.txt"}
    everything = plans.select_files(spark, root, Options(ignore_files=False))
    assert names(root, everything) == set(FILES) | {".gitignore", "src/.ignore"}
    with pytest.raises(ValueError, match="'\\['"):
        plans.select_files(spark, root, Options(include=["["]))


def test_rules_above_the_root_hold(spark, tmp_path):
    texts = {
        "r/.git/HEAD": "x",
        "r/.gitignore": "*.log\n/src/gen\nsrc/\n",
        "r/.git/info/exclude": "*.tmp\n",
        "r/src/a.rs": "x",
        "r/src/a.log": "x",
        "r/src/a.tmp": "x",
        "r/src/gen/b.rs": "x",
        "r/src/in/.gitignore": "!k.log\n",
        "r/src/in/k.log": "x",
        "o/.gitignore": "*",
        "o/a.rs": "x",
    }
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    for scheme in ("", "file://"):
        root = f"{scheme}{tmp_path}/r/src"
        found = names(root, plans.select_files(spark, root))
        assert found == {"a.rs", "in/.gitignore", "in/k.log"}
    # Not in a repository.
    other = f"{tmp_path}/o"
    assert names(other, plans.select_files(spark, other)) == {".gitignore", "a.rs"}
    everywhere = Options(repositories_only=False)
    assert names(other, plans.select_files(spark, other, everywhere)) == set()


def test_measured_files_with_and_without_store(spark, root, tmp_path):
    store = ResultStore.create(spark, str(tmp_path / "store"))
    options = Options(ignore=[".git/**"], min_tokens=2, limit_low=True)
    plain = plans.measured_files(spark, root, options)
    want = {"src/test.rs", "src/test.txt", ".hid", "odd name #1?.txt"}
    want = {p for p in want if p != "odd name #1?.txt"}
    assert names(root, plain) == want
    for _ in range(2):
        assert names(root, plans.measured_files(spark, root, options, store=store)) == want
    seqs = store.log().groupBy("seq").count().collect()
    assert len(seqs) == 1


def test_listed_files(spark, root, tmp_path):
    listed = ["src/test.txt", "missing", "src", ".hid", "empty.txt", "src/test.txt", "link.js", "bad.txt"]
    (tmp_path / "list").write_text("\n".join(f"{root}/{name}" for name in listed) + "\n \n")
    store = ResultStore.create(spark, str(tmp_path / "store"))
    want = ["src/test.txt", ".hid", "src/test.txt", "link.js"]
    for where in (None, store, store):
        found = plans.listed_files(spark, str(tmp_path / "list"), store=where).collect()
        assert sorted(r["path"][len(root) + 1 :] for r in found) == sorted(want)
        assert all(r["error"] is None for r in found)
    assert [r["count"] for r in store.log().groupBy("seq").count().collect()] == [4]
    limits = Options(ignore=["**"], min_tokens=2, limit_low=True)
    kept = plans.listed_files(spark, str(tmp_path / "list"), limits).collect()
    assert {r["tokens"] for r in kept} == {2, 3} and len(kept) == 3


def test_rule_sets(spark, tmp_path, rows):
    (tmp_path / "rules.json").write_text(
        json.dumps({
            "version": 1,
            "contexts": [
                {"context": "rust", "filters": ["*.rs"], "ignores": ["target/**"]},
                {"context": "rust", "filters": ["*.none"]},
                {"context": "all"},
                {"context": "nothing", "filters": []},
            ],
        })
    )
    rule_sets = read_rule_sets(spark, str(tmp_path / "rules.json"))
    assert pick_rule_set(rule_sets, "rust") == RuleSet("rust", ("*.rs",), ("target/**",))
    assert pick_rule_set(rule_sets, "all") == RuleSet("all", ("**",), ())
    with pytest.raises(ValueError, match="'default'"):
        pick_rule_set(rule_sets)
    files = rows([("a.rs",), ("target/a.rs",), ("b.md",), ("c.none",)], "path string")
    found = {tuple(r) for r in select_by_rule_sets(files, rule_sets).collect()}
    assert found == {("rust", "a.rs")} | {("all", p) for p in ("a.rs", "target/a.rs", "b.md", "c.none")}
    (tmp_path / "old.json").write_text('{"version": 2, "contexts": []}')
    with pytest.raises(ValueError, match="2"):
        read_rule_sets(spark, str(tmp_path / "old.json"))


def test_rule_precedence():
    mine = RuleSet("mine", ("*.rs",), ("x",))
    assert effective_rules(["a"], [], mine) == RuleSet("mine", ("a",), ("x",))
    assert effective_rules([], ["b"], mine) == RuleSet("mine", ("*.rs",), ("b",))
    assert effective_rules() == RuleSet("default", ("**",), ())


def test_a_trailing_slash_matches_no_file(rows):
    files = rows([(p,) for p in ["a", "b.lock", "out/x", "out/y/z"]], "path string")
    kept = select_paths(files, ("**",), ("*.lock", "out/"))
    assert [r["path"] for r in kept.collect()] == ["a", "out/x", "out/y/z"]


MEASURED = "path string, content string, tokens bigint, error string"
PAIR = [("b", "bb", 2, None), ("a", "aa\naa", 5, None)]


def texts(folder):
    parts = sorted(name for name in os.listdir(folder) if name.startswith("part-"))
    return "".join(open(os.path.join(folder, name), newline="").read() for name in parts)


def test_merged_text(rows, tmp_path):
    measured = rows(PAIR, MEASURED)
    blocks = [r["block"] for r in merged_blocks(measured).orderBy("path").collect()]
    assert blocks == ["File: a\naa\naa", "File: b\nbb"]
    assert [r["block"] for r in plans.merge(measured).collect()] == blocks
    write_merged_text(measured, str(tmp_path / "ordered"))
    assert texts(tmp_path / "ordered") == "=== Result ===\nFile: a\naa\naa\nFile: b\nbb\n"
    write_merged_text(measured, str(tmp_path / "free"), ordered=False)
    assert sorted(texts(tmp_path / "free").split("\n")) == sorted(texts(tmp_path / "ordered").split("\n"))


def test_merged_json(rows, tmp_path):
    measured = rows(PAIR, MEASURED)
    want = [
        {"path": "a", "content": "aa\naa", "tokens": 5},
        {"path": "b", "content": "bb", "tokens": 2},
    ]
    assert [json.loads(r["json"]) for r in plans.merge(measured, "json").collect()] == want
    write_merged_json(measured, str(tmp_path / "json"))
    assert [json.loads(line) for line in texts(tmp_path / "json").splitlines()] == want
    with pytest.raises(ValueError, match="yaml"):
        plans.merge(measured, "yaml")


def test_written_tree(rows, tmp_path):
    measured = rows([("src/main.rs", "", 3, None), ("src/lib.rs", "", 4, None)], MEASURED)
    lines = ["└── src (7 tokens)", "    ├── lib.rs (4 tokens)", "    └── main.rs (3 tokens)"]
    tree = plans.tree(measured)
    assert [r["line"] for r in tree.collect()] == lines
    write_tree(tree, str(tmp_path / "tree"))
    assert texts(tmp_path / "tree").splitlines() == lines


def test_reports(rows):
    measured = rows([("test1.txt", "", 12, None), ("é.txt", "", 3, None), ("b", "", 12, None)], MEASURED)
    rule = "─" * 29
    head, foot = ["", "Token Statistics:", rule], [rule, "Total tokens: 27"]
    body = [
        "b         │       12 tokens",
        "test1.txt │       12 tokens",
        "é.txt    │        3 tokens",
    ]
    for n in (0, 2, 10):
        lines = [r["line"] for r in plans.tokens(measured, n).collect()]
        assert lines == head + body[:n] + foot
        report = json.loads(plans.tokens(measured, n, "json").first()["json"])
        assert report["total"] == 27
        assert [r["path"] for r in report["results"]] == ["b", "test1.txt", "é.txt"][:n]
    none = measured.limit(0)
    assert [r["line"] for r in plans.tokens(none).collect()][-1] == "Total tokens: 0"
    assert json.loads(plans.tokens(none, form="json").first()["json"]) == {"results": [], "total": 0}
    with pytest.raises(ValueError):
        plans.tokens(measured, form="xml")


def test_budgets(rows):
    measured = rows([(str(n), "", n, None) for n in (0, 1, 5, 10, 10_001)], MEASURED)
    keep = lambda **o: [r["tokens"] for r in plans.within_budget(measured, Options(**o)).collect()]
    assert keep() == [1, 5, 10, 10_001]
    assert keep(limit_high=True) == [1, 5, 10]
    assert keep(limit_low=True) == [1, 5, 10, 10_001]
    assert keep(min_tokens=5, max_tokens=10, limit_low=True, limit_high=True) == [5, 10]
    assert keep(min_tokens=5, max_tokens=10) == [1, 5, 10, 10_001]


def test_a_filter_does_not_repeat_the_measure(rows):
    measured = measure(rows([("a", "b c")], "path string, content string"))
    plan = plans.within_budget(measured, Options())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
