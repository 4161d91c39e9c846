"""Shapes of physical plans that decide how queries scale."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from paddock.operators import aggregates as agg
from paddock.operators import joins, reshape, windows
from paddock.plans import pitstops, projection
from paddock.scratch import materialise
from paddock.sources import lapview as v

ROOT = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def laps(spark):
    return v.laps(spark, ROOT)


def no_cross(text):
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_k_is_limited_before_the_shuffle(spark):
    text = plan(joins.latest_per(laps(spark), ["session_id", "driver_id"], ["lap_number"]))
    assert text.count("WindowGroupLimit") >= 2
    assert text.index("WindowGroupLimit") < text.index("Exchange") or "Partial" in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(agg.elapsed_time(laps(spark), 10, "lap_ms"))
    schema = [line for line in text.splitlines() if line.startswith("ReadSchema")][0]
    assert set(schema[len("ReadSchema: struct<"):-1].split(",")) == {
        "session_id:int", "driver_id:bigint", "lap_number:int", "lap_ms:bigint"
    }


def test_filters_reach_the_scan(spark):
    text = plan(joins.laps_in_stints(laps(spark), v.stints(spark, ROOT), "lap_ms"))
    assert "IsNotNull(lap_ms)" in text and "EqualTo(is_valid,true)" in text.replace(" ", "")
    no_cross(text)


def test_context_join_does_not_shuffle_laps(spark):
    ctx = v.context(spark, ROOT)
    sessions = ctx.select(F.col("session_id").alias("id"), F.col("session_id").alias("race_id"), F.lit("R").alias("session_type"))
    races = ctx.select(F.col("session_id").alias("id"), "season", F.lit(1).alias("round_number"), "circuit_id")
    circuits = ctx.select(F.col("circuit_id").alias("id"), F.lit("c").alias("name")).distinct()
    text = plan(joins.with_context(laps(spark), sessions, races, circuits))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    no_cross(text)


def test_session_windows_are_split(spark):
    """No window may put a whole session into one task: all partition by chunk as well."""
    for df in (windows.session_gaps(laps(spark), "lap_ms"), windows.lap_flags(laps(spark))):
        text = plan(df)
        specs = [line for line in text.splitlines() if line.startswith("Arguments") and "windowspec" in line]
        assert specs and all("_chunk" in s for s in specs)
        no_cross(text)


def test_projection_needs_one_shuffle_after_the_state(spark):
    ctx = v.context(spark, ROOT).select("session_id", F.col("circuit_id").alias("circuit_code"))
    state = materialise(projection.current_state(laps(spark), ctx).withColumn("driver_code", F.lit(0)))
    score = lambda df: df.withColumn("prediction", F.col("tyre_age_laps") * 0.1)
    df = pitstops.pit_windows(state, score)
    text = plan(df)
    tree = text[: text.index("(1)")]
    assert tree.count("Exchange") == 1
    no_cross(text)


def test_page_takes_ordered_rows(spark):
    got, _ = reshape.page(laps(spark).select("session_id", "driver_id", "lap_number"), [F.col("lap_number")], 2, 10)
    assert "TakeOrderedAndProject" in plan(got)


def test_no_python_in_the_core_path(spark):
    for df in (
        joins.gap_features(laps(spark), "lap_ms", 120_000), windows.lap_time_delta(laps(spark), "lap_ms"),
        agg.stint_slopes(laps(spark), v.stints(spark, ROOT), "lap_ms"),
    ):
        text = plan(df)
        assert "Python" not in text and "Arrow" not in text
        no_cross(text)


def test_stints_summed_in_the_task_equal_scored_laps(spark, monkeypatch):
    """A forest sums the laps of a stint where it makes them; windows are those of laps scored one by one."""
    import numpy as np

    from paddock import fixed
    from paddock.ml import boosting, tyres

    rng = np.random.default_rng(3)
    inner, count = 7, len(fixed.TYRE_FEATURES)
    grown = {
        (m, h): (0.25, rng.integers(0, count, (5, inner)), rng.choice([-2.0, 1.5, 4.0, 9.0, 17.0, np.inf], (5, inner)), np.ones((5, 2 * inner + 1)), rng.normal(size=(5, inner + 1)))
        for m in ("soft", "hard", "wet") for h in (-1, 0)
    }
    score = tyres.model_score(boosting.Forest(fixed.TYRE_FEATURES, grown))
    data = [
        (s, d, 1 + (5 * d + s) % 20, c, None if d == 3 else d % 6, d, 20 + s, None if d == 4 else s, d * 7 % 11)
        for s in range(2) for d, c in enumerate(("SOFT", "HARD", "WET", "MEDIUM", "INTERMEDIATE", None, "SOFT", "HARD"))
    ]
    state = spark.createDataFrame(data, "session_id int, driver_id int, lap_number int, compound string, tyre_age_laps int, position int, total_laps int, circuit_code int, driver_code int")
    plain = pitstops.pit_windows(state, lambda df: score(df)).collect()
    seen = []
    kept = tyres.ForestScore.stints
    monkeypatch.setattr(tyres.ForestScore, "stints", lambda *a: seen.append(1) or kept(*a))
    monkeypatch.setattr(boosting, "SCORE_ROWS", 37)
    got = pitstops.pit_windows(state, score).collect()
    key = lambda r: (r.session_id, r.driver_id, r.pit_lap)
    assert seen and len(got) == len(plain) > 30 and [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(plain, key=key)]
    for a, b in zip(sorted(got, key=key), sorted(plain, key=key), strict=True):
        assert a.projected_total_delta_seconds == pytest.approx(b.projected_total_delta_seconds, abs=1e-9) and a.window_end == b.window_end
