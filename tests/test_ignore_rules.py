import os
import random
import subprocess
import timeit

import pytest

from tallygrove.operators.ignore_rules import compile_rules, drop_ignored, parse_ignore_files, repositories
from tallygrove.operators.rule_chains import Chains
from tallygrove.plans.documents import IgnoringWalk, select_files
from tallygrove.sources.file_tree import list_files

RULES = {
    ".gitignore": "*.log\n!keep.log\nbuild/\n/tmp\n# c\n\nsrc/**/n.txt\n",
    "src/.gitignore": "!x.log\n*.o\nb/m.rs\n",
    "a/b/.gitignore": "/*\n!n.txt\n",
    "b/.gitignore": "a/**\n**/tmp/*.rs\n",
}
MORE = {
    ".gitignore": "[ab].rs\n?.txt\n\\#x\n\\!y\ntrail  \nb/**/x.log\n",
    "src/.gitignore": "/a\n*\n!*/\n!x.o\r\n",
    "a/.gitignore": "b/\n!b/keep.log\n",
    "b/.gitignore": "**/src\nn.txt/\n[!a]*.o\n",
}
NAMES = ["x.log", "keep.log", "m.rs", "a.rs", "n.txt", "y.txt", "x.o", "#x", "!y", "trail", "t.md"]


def random_tree(seed):
    chance = random.Random(seed)
    folders = [""]
    for _ in range(40):
        folder = chance.choice(folders)
        if folder.count("/") < 4:
            folders.append(folder + chance.choice(["src", "a", "b", "build", "tmp", "n.txt"]) + "/")
    return sorted({f + name for f in folders for name in chance.sample(NAMES, 5)} - set(map(lambda f: f[:-1], folders)))


@pytest.mark.parametrize("rules", [RULES, MORE])
@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_git(spark, tmp_path, lookups, rules, seed):
    paths = [p for p in random_tree(seed)]
    for path in paths + list(rules):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(rules.get(path, ""), newline="")
    git = {"cwd": tmp_path, "check": True, "capture_output": True}
    subprocess.run(["git", "init", "-q"], **git)
    listed = subprocess.run(
        ["git", "-c", "core.excludesFile=", "ls-files", "--others", "--exclude-standard", "-z"],
        env={**os.environ, "GIT_CONFIG_GLOBAL": "/dev/null"},
        **git,
    )
    expected = set(listed.stdout.decode().split("\0")) - {""}

    everything = paths + list(rules)
    files = spark.createDataFrame([(p,) for p in everything], "path string")
    parsed = parse_ignore_files(spark.createDataFrame(list(rules.items()), "path string, content string"))
    kept = {row["path"] for row in drop_ignored(files, parsed).collect()}
    assert kept == expected
    assert 0 < len(kept) < len(everything)


def kept(spark, paths, rules):
    files = spark.createDataFrame([(p, len(p)) for p in paths], "path string, n int")
    parsed = parse_ignore_files(spark.createDataFrame(list(rules.items()), "path string, content string"))
    out = drop_ignored(files, parsed)
    assert out.columns == ["path", "n"]
    return {row["path"] for row in out.collect()}


def test_later_kinds_of_file_overrule(spark):
    rules = {"a/.gitignore": "*.x\n", ".ignore": "!k.x\n*.y\n", "a/.ignore": "!z.y\n"}
    paths = ["a/k.x", "a/l.x", "a/q.y", "a/z.y", "z.y"]
    assert kept(spark, paths, rules) == {"a/k.x", "a/z.y"}


def test_no_rules_keep_all(spark):
    assert kept(spark, ["a", "b/c"], {"x.txt": "*"}) == {"a", "b/c"}


def test_a_pattern_that_is_not_valid_is_left_out(spark):
    assert kept(spark, ["a", "b"], {".gitignore": "[z\nb\n"}) == {"a"}


def test_exclude_file_is_the_weakest(spark):
    rules = {"r/.git/info/exclude": "*.x\n*.y\n", "r/a/.gitignore": "!k.x\n"}
    paths = ["r/a/k.x", "r/k.x", "r/b.y", "q.x", "r/z"]
    assert kept(spark, paths, rules) == {"r/a/k.x", "q.x", "r/z"}


def test_git_rules_hold_in_their_repository_only(spark):
    rules = {
        ".gitignore": "*.x\n",
        "r/.gitignore": "*.y\n",
        "r/s/.gitignore": "*.z\n",
        "o/.gitignore": "*\n",
        ".ignore": "*.w\n",
    }
    paths = ["r/a.x", "r/a.y", "r/s/a.x", "r/s/a.y", "r/s/a.z", "o/a.x", "o/a.w", "r/s/a.w", "a.x"]
    listing = spark.createDataFrame(
        [(p,) for p in paths + ["r/.git/config", "r/s/.git"]], "path string"
    )
    tops = repositories(listing)
    assert {r["base"] for r in tops.collect()} == {"r", "r/s"}
    parsed = parse_ignore_files(spark.createDataFrame(list(rules.items()), "path string, content string"))
    found = {r["path"] for r in drop_ignored(listing, parsed, tops).collect()}
    inside = {"r/a.x", "r/s/a.x", "r/s/a.y", "r/.git/config", "r/s/.git"}
    assert found == inside | {"o/a.x", "a.x"}


def test_an_ignored_directory_hides_a_repository_in_it(spark, lookups):
    rules = {"r/.gitignore": "s/\n", "r/s/.gitignore": "*.z\n"}
    listing = spark.createDataFrame([(p,) for p in ["r/a", "r/s/a.x", "r/t/s/b", "r/.git", "r/s/.git"]], "path string")
    parsed = parse_ignore_files(spark.createDataFrame(list(rules.items()), "path string, content string"))
    found = {r["path"] for r in drop_ignored(listing, parsed, repositories(listing)).collect()}
    assert found == {"r/a", "r/.git"}


def lines(n):
    """Rules of which most are names, endings, beginnings and paths."""
    forms = ["name{}", "*.end{}", "start{}*", "/some/path{}", "name{}/", "!name{}"]
    return "".join(forms[k % 6].format(k) + "\n" for k in range(n - 2)) + "q?\n!some/**/r\n"


def test_many_rules_cost_little(spark):
    """400 rules take a path hardly longer than two."""
    files = parse_ignore_files(spark.createDataFrame([(".gitignore", lines(400)), ("few/.gitignore", lines(2))], "path string, content string"))
    held = {base: [("", *row[1:]) for row in map(tuple, files.where(files["base"] == base).collect())] for base in ("", "few")}
    paths = [f"/d{k % 50}/e{k % 7}/name{k}.end{k % 900}" for k in range(40_000)]
    seconds = {}
    for base, rules in held.items():
        def judged(rules=rules):
            chains = Chains(rules, None)
            return sum(map(chains.gone, paths))

        assert (judged() > 0) == (base == "")
        seconds[base] = min(timeit.repeat(judged, number=1, repeat=3))
    assert seconds[""] < 2 * seconds["few"] + 0.1


@pytest.mark.parametrize("seed", range(3))
def test_chains_equal_the_joins(spark, monkeypatch, seed):
    draw = random.Random(seed)
    names = ["a", "b", "name0", "name4", "x.end1", "start2y", "some", "path3", "q1", "r", ".git"]
    paths = sorted({"/".join(draw.choices(names, k=draw.randint(1, 5))) for _ in range(400)})
    rules = {"/".join([*draw.choices(names[:7], k=draw.randint(0, 3)), draw.choice([".gitignore", ".ignore"])]): lines(draw.choice([5, 20])) for _ in range(8)}
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    parsed = parse_ignore_files(spark.createDataFrame(list(rules.items()), "path string, content string"))
    found = []
    for bound in (16 << 20, -1):
        monkeypatch.setattr("tallygrove.operators.skew.LOOKUP_BYTES", bound)
        some = [
            {r["path"] for r in drop_ignored(listing, parsed, tops, top, is_dir).collect()}
            for tops, top, is_dir in ((None, "", False), (repositories(listing), "a", False), (None, "a", True))
        ]
        found.append(some)
    assert found[0] == found[1]
    assert any(0 < len(kept) < len(paths) for kept in found[0])


def test_ignored_directories_are_not_listed(spark, tmp_path):
    tree = {
        ".git/info/exclude": "out/\n", ".gitignore": "node_modules/\n*.log\n", "node_modules/x/y/z.js": "", "out/a": "",
        "src/.gitignore": "gen*/\n!gen2/\n", "src/gen1/a": "", "src/gen2/b": "", "src/c.log": "", "src/d": "", "lib/out/e": "",
    }
    for path, text in tree.items():
        target = tmp_path / "top" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    root = str(tmp_path / "top")
    walk, listed = IgnoringWalk(spark, root), []

    def prune(entries):
        kept = walk.prune(entries)
        listed.extend(r["path"][len(root) + 1 :] for r in kept.collect())
        return kept

    files = list_files(spark, root, prune=prune)
    assert set(listed) == {".git", ".git/info", "src", "src/gen2", "lib"}
    kept = {r["path"][len(root) + 1 :] for r in walk.kept(files).collect()}
    assert kept == {".git/info/exclude", ".gitignore", "src/.gitignore", "src/gen2/b", "src/d"}
    assert {r["path"][len(root) + 1 :] for r in select_files(spark, root).collect()} == kept


FORMS = ["na{}", "*.e{}", "st{}*", "/a/b{}", "n{}/", "!n{}", "q{}?", "?{}q", "a/?{}*", "a/**/x{}", "{{a{},b}}", "[ab]{}", "x[!c]{}", "**", "*", "a/*/{}*", "{},a", "\\*{}", "**/a{}/b", "a{}/**", "/{}?b"]


@pytest.mark.parametrize("seed", range(2))
def test_joins_of_all_forms_equal_the_chains(spark, monkeypatch, seed):
    draw = random.Random(seed)
    parts = ["a", "b", "b1", "a2", "na1", "x.e2", "st1y", "n1", "q1z", "x1", "xd2", "1", "*1", "1,a", ".git", "é1q", "1zb"]
    paths = sorted({"/".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(600)})
    forms = [f.format(k) + "\n" for f in FORMS if f not in ("**", "*") for k in (1, 2)]
    rules = {
        "/".join([*draw.choices(parts[:3], k=draw.randint(0, 2)), draw.choice([".gitignore", ".ignore"])]):
        "".join(draw.choices(["*\n", "**\n", "!*\n"], k=1) * (draw.random() < 0.3) + [draw.choice(["", "!"]) * (not f.startswith("!")) + f for f in draw.choices(forms, k=6)])
        for _ in range(8)
    }
    listing = spark.createDataFrame([(p,) for p in [*paths, None]], "path string")
    parsed = parse_ignore_files(spark.createDataFrame(list(rules.items()), "path string, content string"))
    tops, found = repositories(listing), []
    listing = listing.where("path is not null")
    for bound in (16 << 20, -1):
        monkeypatch.setattr("tallygrove.operators.skew.LOOKUP_BYTES", bound)
        found.append([{r["path"] for r in drop_ignored(listing, parsed, t).collect()} for t in (None, tops)])
    assert found[0] == found[1]
    assert any(0 < len(kept) < len(paths) for kept in found[0])


def test_joined_rules_of_one_directory_cost_no_more_each(spark, monkeypatch):
    """As many rules as files, in one directory: a file meets those of its own handles."""
    monkeypatch.setattr("tallygrove.operators.skew.LOOKUP_BYTES", -1)
    seconds = {}
    for n in (50, 8000):
        files = spark.range(8000).selectExpr("concat('d/', id, '.txt') as path")
        lines = spark.range(n).selectExpr("'d' as base", "1 as level", "cast(id as int) as line", "concat(id, '.t?t') as value")
        started = timeit.default_timer()
        assert drop_ignored(files, compile_rules(lines)).count() == 8000 - n
        seconds[n] = timeit.default_timer() - started
    assert seconds[8000] < 2 * seconds[50] + 5
