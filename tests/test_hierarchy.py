from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallygrove.operators.hierarchy import last_children, pre_order, rollup, tree_lines

SCHEMA = "path string, tokens bigint, seq bigint"


def naive_tree(files):
    """{parts: tokens} of all nodes, the last row of a path winning."""
    last = {tuple(path.split("/")): tokens for path, tokens, _ in sorted(files, key=lambda f: f[2])}
    inner = {parts[:k] for parts in last for k in range(len(parts))}
    nodes = {}
    for parts, tokens in last.items():
        if parts not in inner:
            for k in range(len(parts) + 1):
                nodes[parts[:k]] = nodes.get(parts[:k], 0) + tokens
    return nodes


def naive_lines(nodes, parts=(), indent="", is_last=True):
    lines = []
    name = parts[-1] if parts else ""
    if name:
        lines.append(f"{indent}{'└── ' if is_last else '├── '}{name} ({nodes[parts]} tokens)")
        indent += "    " if is_last else "│   "
    children = sorted(n for n in nodes if len(n) == len(parts) + 1 and n[:-1] == parts)
    for child in children:
        lines += naive_lines(nodes, child, indent, child == children[-1])
    return lines


def check(spark, files):
    measured = spark.createDataFrame(files, SCHEMA)
    nodes = naive_tree(files)
    found = pre_order(rollup(measured, order_col="seq")).collect()
    assert [tuple(r["node"]) for r in found] == sorted(nodes)
    assert {tuple(r["node"]): r["tokens"] for r in found} == nodes
    for row in found:
        assert row["name"] == (row["node"] or [""])[-1]
        assert row["depth"] == len(row["node"])
        assert row["parent"] == (row["node"][:-1] if row["node"] else None)
    lines = [r["line"] for r in pre_order(tree_lines(measured, order_col="seq")).collect()]
    assert lines == naive_lines(nodes)


def test_small_tree(spark):
    files = [("src/main.rs", 1, 0), ("src/lib.rs", 2, 1), ("README.md", 4, 2)]
    measured = spark.createDataFrame(files, SCHEMA)
    nodes = {tuple(r["node"]): r["tokens"] for r in rollup(measured).collect()}
    children = lambda of: [n for n in nodes if n and n[:-1] == of]
    assert len(children(())) == 2 and len(children(("src",))) == 2
    assert children(("README.md",)) == []
    assert nodes[()] == 7 and nodes[("src",)] == 3
    last = {tuple(r["node"]) for r in last_children(rollup(measured)).collect()}
    assert last == {("src",), ("src", "main.rs")}
    check(spark, files)


def test_odd_paths(spark, lookups):
    """Empty names, files that are directories, repeated paths, names around the slash."""
    paths = ["/a/b", "a", "a/b", "a/b/c", "a-b/c", "a/b", "a//b", "x/", "é/z", "a b/c", "/", "b/c/d/e/f"]
    check(spark, [(path, 3 + 2 * i, i) for i, path in enumerate(paths)])


def test_repeated_path_keeps_the_last(spark):
    measured = spark.createDataFrame([("a/b", 5, 0), ("a/b", 7, 1)], SCHEMA)
    assert {r["tokens"] for r in rollup(measured, order_col="seq").collect()} == {7}


part = st.sampled_from(["a", "b", "-", "", "zz"])
path = st.lists(part, min_size=1, max_size=4).map("/".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(paths=st.lists(path, min_size=1, max_size=12))
def test_random_trees(spark, paths):
    check(spark, [(p, i + 1, i) for i, p in enumerate(paths)])
