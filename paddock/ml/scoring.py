"""Batch scoring of completed laps to prediction rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock import fixed
from paddock.functions.scalars import (
    compound_code, compound_model, forward_fuel, forward_fuel_load, optimal_pit_lap,
)
from paddock.operators.aggregates import DRIVER, elapsed_time
from paddock.operators.windows import position_context
from paddock.plans.projection import Score, life_remaining
from paddock.plans.safetycar import with_next_lap_sc
from paddock.plans.undercut import overcut, undercut, undercut_roles
from paddock.scratch import materialise


def score_laps(
    batch: DataFrame,
    laps: DataFrame,
    state: DataFrame,
    rates: DataFrame,
    score_tyre: Score,
    score_pit: Score,
    model_version: str = "production",
    pit_lap_from: str = "predicted_delta",
) -> DataFrame:
    """One prediction row per completed lap.

    ``batch``: completed laps.  ``laps``: the lap table with them in it.  ``state``: current
    state of every driver with codes and circuit_name.  tire_life_remaining is the
    predicted delta in seconds, as stored predictions have always held; the lap count is
    life_laps, and ``pit_lap_from`` chooses which of the two moves optimal_pit_lap.
    """
    # All that follows is about the sessions of the batch; a lap table partitioned by session
    # is read in those partitions only.
    batch = materialise(batch, "batch")
    touched = batch.select("session_id").distinct()
    laps = laps.join(touched, "session_id", "left_semi")
    state = state.join(touched, "session_id", "left_semi")
    wanted = batch.select(*DRIVER).distinct()
    field = position_context(laps, wanted)
    facts = state.select(*DRIVER, "total_laps", "circuit_code", "driver_code", "circuit_name")
    rows = (
        batch.select(*DRIVER, "lap_number", F.upper("compound").alias("compound"), "tyre_age_laps")
        .join(facts, list(DRIVER))
        .join(field, list(DRIVER))
    )
    rows = with_next_lap_sc(rows, rates).withColumns(
        {
            "compound_encoded": compound_code("compound"),
            "tyre_model": compound_model("compound"),
            "fuel_adjusted_time": forward_fuel("lap_number", "total_laps"),
            "circuit_id_encoded": F.col("circuit_code"),
            "driver_id_encoded": F.col("driver_code"),
        }
    )
    held = materialise(rows, "score")
    key = [*DRIVER, "lap_number"]
    life = life_remaining(held, key, score_tyre)
    tyre_cols = [*key, *[f for f in fixed.TYRE_FEATURES if f != "lap_number"], "tyre_model"]
    delta = score_tyre(held.select(*tyre_cols)).select(*key, F.col("prediction").alias("_delta"))
    joined = held.join(life, key).join(delta, key)
    features = joined.select(
        *key, "_delta", "life_remaining",
        F.col("tyre_age_laps").alias("current_tyre_age"),
        F.col("life_remaining").alias("predicted_life_remaining"),
        "gap_to_car_ahead", "gap_to_car_behind", "safety_car_probability",
        (F.col("total_laps") - F.col("lap_number")).alias("laps_to_race_end"),
        "position",
        forward_fuel_load("lap_number", "total_laps").alias("fuel_load_est"),
    )
    chance = score_pit(features).select(
        *key, "_delta", "life_remaining", "safety_car_probability", F.col("prediction").alias("pit_probability")
    )

    ahead = held.filter("ahead_driver_id is not null").select(
        *DRIVER, F.col("ahead_driver_id").alias("target_driver_id")
    ).distinct()
    behind = held.filter("behind_driver_id is not null").select(
        *DRIVER, F.col("behind_driver_id").alias("target_driver_id")
    ).distinct()
    target = F.col("target_driver_id").alias("driver_id")
    needed = wanted.union(ahead.select("session_id", target)).union(behind.select("session_id", target)).distinct()
    roles = materialise(undercut_roles(state.join(needed, list(DRIVER), "left_semi"), score_tyre), "roles")
    elapsed = elapsed_time(laps)
    under = undercut(ahead, roles, elapsed).select(*DRIVER, F.col("probability").alias("_under"))
    over = overcut(behind, roles, elapsed).select(*DRIVER, F.col("probability").alias("_over"))
    used = F.col("_delta") if pit_lap_from == "predicted_delta" else F.col("life_remaining")
    return chance.join(under, list(DRIVER), "left").join(over, list(DRIVER), "left").select(
        *DRIVER, "lap_number",
        optimal_pit_lap("lap_number", used).alias("optimal_pit_lap"),
        "pit_probability",
        F.coalesce("_under", F.lit(0.0)).alias("undercut_score"),
        F.coalesce("_over", F.lit(0.0)).alias("overcut_score"),
        F.col("_delta").alias("tire_life_remaining"),
        F.col("life_remaining").alias("life_laps"),
        "safety_car_probability",
        F.lit(0.0).alias("confidence_score"),
        F.lit(model_version).alias("model_version"),
    )


def lap_scorer(
    laps: Callable[[], DataFrame], state: Callable[[DataFrame], DataFrame], rates: DataFrame,
    score_tyre: Score, score_pit: Score,
) -> Callable[[DataFrame], DataFrame]:
    """Scorer for micro-batches: reads the stored laps anew for every batch."""

    def score(batch: DataFrame) -> DataFrame:
        held = laps()
        return score_laps(batch, held, state(held), rates, score_tyre, score_pit)

    return score
