"""Pit plans: projected finish, place among rivals, sampled finish times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock import fixed
from paddock.functions.scalars import hash_gaussian
from paddock.operators.aggregates import DRIVER
from paddock.operators.ordered import over_order
from paddock.plans.projection import Score, project_stints, spread
from paddock.scratch import materialise

Z95 = 1.6449


def plan_finishes(
    state: DataFrame, elapsed: DataFrame, plans: DataFrame, score: Score, keys: Sequence[str] = ("plan_id",)
) -> DataFrame:
    """Finish time of each plan: elapsed time, projected stints and the stops.

    ``plans`` has plan_id, session_id, driver_id, pit_laps and compounds; the compound at
    the same place is fitted at that stop.  Stops outside the rest of the race are ignored.
    A plan is known by ``keys``, which come first in the output.
    """
    keys = list(keys)
    rows = plans.join(state, list(DRIVER)).join(elapsed, list(DRIVER))
    stops = F.filter(
        F.arrays_zip(F.col("pit_laps").alias("lap"), F.col("compounds").alias("compound")),
        lambda s: (s["lap"] > F.col("lap_number")) & (s["lap"] < F.col("total_laps")),
    )
    rows = spread(rows, keys).withColumn("_stops", F.array_sort(F.array_distinct(stops)))
    begin = F.array(
        F.struct(F.col("lap_number").alias("lap"), F.col("compound"), F.col("tyre_age_laps").alias("age"))
    )
    stints = F.concat(
        begin,
        F.transform("_stops", lambda s: F.struct(s["lap"].alias("lap"), s["compound"].alias("compound"), F.lit(0).alias("age"))),
    )
    ends = F.concat(F.transform("_stops", lambda s: s["lap"]), F.array("total_laps"))
    shared = ("total_laps", "circuit_code", "driver_code")
    expanded = (
        rows.withColumn("_stints", stints)
        .withColumn("_ends", ends)
        .select(*keys, *DRIVER, *shared, "_ends", F.posexplode("_stints").alias("segment", "_s"))
        .select(
            *keys, "segment", *shared,
            F.col("_s.compound").alias("compound"),
            (F.col("_s.lap") + 1).alias("start_lap"),
            (F.get("_ends", F.col("segment")) - F.col("_s.lap")).alias("n_laps"),
            F.col("_s.age").alias("start_age"),
        )
    )
    sums = project_stints(expanded, [*keys, "segment"], score).groupBy(*keys).agg(
        F.sum("projected").alias("_projected")
    )
    facts = rows.select(
        *keys, *DRIVER, "pit_laps", "compounds", "elapsed",
        F.size("_stops").alias("stops"),
        (F.col("total_laps") - F.col("lap_number")).alias("laps_left"),
    )
    half = Z95 * fixed.LAP_NOISE_SECONDS * F.sqrt(F.greatest("laps_left", F.lit(0)).cast("double"))
    finish = F.col("elapsed") + F.col("_projected") + fixed.PIT_STOP_SECONDS * F.col("stops")
    return facts.join(sums, keys).select(
        *keys, *DRIVER, "pit_laps", "compounds", "stops", "laps_left",
        finish.alias("finish_seconds"), (finish - half).alias("low_seconds"), (finish + half).alias("high_seconds"),
    )


def rival_plans(state: DataFrame, overview: DataFrame) -> DataFrame:
    """Every driver with one stop at the lap the overview predicts, same compound again."""
    return state.select(*DRIVER, "compound").join(
        overview.select(*DRIVER, "predicted_pit_lap"), list(DRIVER)
    ).select(
        F.to_json(F.struct(*DRIVER)).alias("plan_id"), *DRIVER,
        F.array("predicted_pit_lap").alias("pit_laps"), F.array("compound").alias("compounds"),
    )


def evaluate_plans(
    state: DataFrame, elapsed: DataFrame, plans: DataFrame, overview: DataFrame, score: Score
) -> DataFrame:
    """Plans with finish time, interval and place among the session's other drivers.

    A plan's place is 1 + rivals ahead of it, from one projection and one ordered pass over plans
    and rivals together, so no plan is paired with every rival.
    """
    own_columns = ["plan_id", *DRIVER, "pit_laps", "compounds"]
    state, elapsed = materialise(state, "state"), materialise(elapsed, "elapsed")
    asked = plans.select(*own_columns).withColumn("_rival", F.lit(0)).unionByName(
        rival_plans(state, overview).select(*own_columns).withColumn("_rival", F.lit(1))
    )
    # One row per plan: written before the ordered pass, which would project them again to
    # find its ranges.
    both = materialise(plan_finishes(state, elapsed, asked, score, ("plan_id", "_rival")), "finishes")
    own = both.filter("_rival = 1").select(*DRIVER, F.col("finish_seconds").alias("_own"))
    placed = over_order(
        both, ["session_id"], ["finish_seconds", "_rival", "plan_id"], sums={"_ahead": "_rival"}
    ).filter("_rival = 0")
    self_ahead = F.when(F.col("_own") < F.col("finish_seconds"), 1).otherwise(0)
    return placed.join(own, list(DRIVER)).select(
        *[c for c in both.columns if c != "_rival"], (F.col("_ahead") - self_ahead + 1).cast("int").alias("predicted_position")
    )


def sample_finish_times(finishes: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """``n`` draws per plan around its projected finish, repeatable for a seed."""
    draws = spread(finishes, ["plan_id"]).withColumn(
        "sim", F.explode(F.sequence(F.lit(1), F.lit(n)))
    )
    noise = hash_gaussian(F.lit(seed), F.col("sim"), F.col("session_id"), F.col("driver_id"))
    spread_s = fixed.LAP_NOISE_SECONDS * F.sqrt(F.greatest("laps_left", F.lit(0)).cast("double"))
    return draws.select(
        "sim", *DRIVER, (F.col("finish_seconds") + noise * spread_s).alias("finish_time")
    )
