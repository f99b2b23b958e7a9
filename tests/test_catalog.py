"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tallygrove.catalog import queries
from tallygrove.catalog.oracles import ORACLES
from tallygrove.catalog.queries import QUERIES
from tallygrove.session import scratch_dir
from tests.conftest import SF


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{name}'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(value is not None, value) for value in row])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, name):
    result = entry_points.queries()[name](spark, SF)
    columns = sorted(result.columns)
    relation = tables.sql(entry_points.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    expected = relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    found = [tuple(row) for row in result.select(*columns).collect()]
    assert ordered(found) == ordered(expected)
    assert len(found) > 0


def test_entry(spark):
    assert [row["tokens"] for row in entry_points.entry(spark).collect()][0] > 0


def test_a_stream_reads_three_batches_of_bounded_files(spark, monkeypatch):
    places = []

    def noted(session):
        places.append(scratch_dir(session))
        return places[-1]

    monkeypatch.setattr(queries, "scratch_dir", noted)
    wanted = sorted(QUERIES["stream_incremental"](spark, SF).collect())
    monkeypatch.setattr(queries, "FILE_BYTES", 20_000)
    found = QUERIES["stream_incremental"](spark, SF)
    assert sorted(found.collect()) == wanted
    log, versions = (spark.read.parquet(place) for place in places[3:5])
    assert len(versions.inputFiles()) > len(spark.read.parquet(places[1]).inputFiles())
    assert log.select("seq").distinct().count() == 5
