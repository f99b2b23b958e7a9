"""What the plans must not do, and the orders they must give."""

import pytest

from tests.conftest import SF
from tallygrove.catalog.queries import QUERIES
from tallygrove.operators import ranking
from tallygrove.sinks.reports import report_json, report_lines

PIECES = "regexp_replace(content"


def executed(frame):
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairs_of_all_rows_and_no_single_task_windows(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "Window" not in plan


@pytest.mark.parametrize("report", [report_lines, report_json])
def test_a_report_measures_once(spark, report):
    from tallygrove.catalog.queries import measured

    plan = executed(report(measured(spark, SF), 5))
    assert plan.count("ReusedExchange") == 1


def test_a_rollup_measures_once(spark):
    plan = executed(QUERIES["tree_rollup_web"](spark, SF))
    assert plan.count(PIECES) == 1


def test_merged_output_is_ordered_and_measures_only_what_it_shows(spark):
    for name, measures in [("merge_blocks", 0), ("merge_json", 1), ("merge_within_budget", 1)]:
        merged = QUERIES[name](spark, SF)
        paths = [row["path"] for row in merged.collect()]
        assert paths == sorted(paths) and len(paths) > 20
        assert executed(merged).count(PIECES) == measures


@pytest.mark.parametrize("name", ["glob_include", "context_rules", "ignore_rules", "store_hits"])
def test_contents_are_not_read_for_paths(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "documents.parquet" in line]
    assert scans and not any("text:string" in line for line in scans)


@pytest.mark.parametrize("name", ["glob_include", "glob_ignore", "context_rules"])
def test_path_rules_are_narrow(spark, name):
    assert "Exchange" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_the_top_list_is_no_full_sort(spark):
    plan = QUERIES["token_top_n"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_order_by_tokens(rows):
    table = rows([("b", 1), ("a", 1), ("c", 9), ("b", 1)], "path string, tokens bigint")
    assert [tuple(r) for r in ranking.by_tokens(table).collect()] == [
        ("c", 9), ("a", 1), ("b", 1), ("b", 1),
    ]
    assert [tuple(r) for r in ranking.top_files(table, 2).collect()] == [("c", 9), ("a", 1)]
    assert ranking.top_files(table, 0).count() == 0
    assert ranking.top_files(table, 99).count() == 4
    assert ranking.token_total(table).first()[0] == 12
    assert ranking.token_total(table.limit(0)).first()[0] == 0
    assert ranking.widest_path(table.limit(0)).first()[0] == 0
