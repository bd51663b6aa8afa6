import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from proofloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Evaluate column expressions on literal rows: rows(data, schema, *columns)."""
    def run(data, schema, *columns):
        out = spark.createDataFrame(data, schema)
        return [tuple(r) for r in (out.select(*columns) if columns else out).collect()]
    return run
