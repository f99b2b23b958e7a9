"""Token reports: the N largest files and the total of all."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.text import left_cell, right_cell
from tallygrove.operators.ranking import DEFAULT_TOP, top_files

# The parts of the plain report.
TITLE = "Token Statistics:"
RULE = "─"
RULE_EXTRA = 20
CELL_RULE = " │ "
CELL_UNIT = " tokens"
TOTAL = "Total tokens: "


def _shared(measured: DataFrame) -> DataFrame:
    """(path, tokens) behind an exchange.

    A report reads them twice, for the largest and for the total. Equal exchanges are
    reused, so the texts are read and measured once and only these two columns move.
    """
    return measured.select("path", "tokens").hint("rebalance")


def _summary(slim: DataFrame) -> Column:
    # Both columns are used here and in the top list, or the exchanges would differ.
    total = F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint")
    width = F.coalesce(F.max(F.octet_length("path")), F.lit(0))
    return slim.agg(F.struct(total.alias("total"), width.alias("width")).alias("sums")).scalar()


def _report(measured: DataFrame, n: int) -> DataFrame:
    """One row: `top`, an array of at most n (order, path, tokens), and `sums`."""
    slim = _shared(measured)
    row = F.struct((-F.col("tokens")).alias("order"), "path", "tokens")
    top = top_files(slim, n).agg(F.array_sort(F.collect_list(row)).alias("top"))
    return top.select("top", _summary(slim).alias("sums"))


def report_lines(measured: DataFrame, n: int = DEFAULT_TOP) -> DataFrame:
    """(line_no, line) of the plain report, n + 5 rows at most.

    Columns are as wide as the longest path of all rows, in bytes.
    """
    width = F.col("sums.width")
    rule = F.repeat(F.lit(RULE), width + RULE_EXTRA)
    rows = F.transform(
        "top",
        lambda row: F.concat(
            left_cell(row["path"], width),
            F.lit(CELL_RULE),
            right_cell(row["tokens"]),
            F.lit(CELL_UNIT),
        ),
    )
    head = F.array(F.lit(""), F.lit(TITLE), rule)
    foot = F.array(rule, F.concat(F.lit(TOTAL), F.col("sums.total").cast("string")))
    lines = F.posexplode(F.concat(head, rows, foot)).alias("line_no", "line")
    return _report(measured, n).select(lines).orderBy("line_no")


def report_json(measured: DataFrame, n: int = DEFAULT_TOP) -> DataFrame:
    """One row `json`: {"results": [{path, tokens}, …], "total": …}."""
    results = F.transform("top", lambda row: F.struct(row["path"], row["tokens"]))
    body = F.struct(results.alias("results"), F.col("sums.total").alias("total"))
    return _report(measured, n).select(F.to_json(body).alias("json"))
