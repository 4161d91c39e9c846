"""Every registered query against DuckDB, with groups split into several chunks."""

import pytest

import __spark_entry__ as entry
from checks import base
from checks.compare import compare, connect

ROOT = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_query(spark, con, small_chunks, name):
    line = compare(spark, ROOT, name, entry.queries()[name], ORACLES.get(name), con)
    # The smallest orders table has no session in the ten-minute window.
    assert line.startswith("ok") or (name == "t04_upcoming_sessions" and line.startswith("EMPTY")), line


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "session_id", "driver_id", "lap_number", "position", "gap_to_ahead_ms", "gap_to_behind_ms"
    ]


def test_lap_view_totals(spark):
    from pyspark.sql import functions as F

    from paddock.sources import lapview as v

    held = v.laps(spark, ROOT).groupBy("session_id").agg(F.count("*"), F.count("lap_ms"), F.sum("lap_ms"), F.sum("position")).orderBy("session_id")
    assert [tuple(r) for r in held.collect()] == [
        (0, 344, 330, 37155680, 2282), (1, 354, 338, 36459420, 2418), (2, 302, 282, 30651450, 2054)
    ]
    assert (v.stints(spark, ROOT).count(), v.contracts(spark, ROOT).count()) == (176, 39)
