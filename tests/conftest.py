import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallygrove.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        4,
        app="tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """rows(data, schema) -> DataFrame."""
    return lambda data, schema: spark.createDataFrame(data, schema)


@pytest.fixture(params=["broadcast", "salted"])
def lookups(request, monkeypatch):
    """Slim lookups as for small tables, and as for large ones with hot keys."""
    if request.param == "salted":
        monkeypatch.setattr("tallygrove.operators.skew.LOOKUP_BYTES", -1)
        monkeypatch.setattr("tallygrove.operators.skew.TASK_ROWS", 2)
