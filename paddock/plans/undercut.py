"""Undercut and overcut chances for pairs of drivers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock import fixed
from paddock.functions.scalars import normal_cdf
from paddock.operators.aggregates import DRIVER
from paddock.plans.projection import Score, project_stints, spread

# Three independent stint draws over n, 1 and n - 1 laps.
NOISE = fixed.LAP_NOISE_SECONDS * math.sqrt(2 * fixed.UNDERCUT_LAPS)


def undercut_roles(state: DataFrame, score: Score, laps: int = fixed.UNDERCUT_LAPS) -> DataFrame:
    """Projected deltas of each driver pitting now and pitting one lap later.

    Both are functions of one driver, so they are computed once per driver and every
    pair only looks them up.
    """

    def part(role: str, start: int, n: int, age) -> F.Column:
        return F.struct(
            F.lit(role).alias("role"), (F.col("lap_number") + start).alias("start_lap"),
            F.lit(n).alias("n_laps"), age.alias("start_age"),
        )

    fresh = F.lit(0)
    stints = spread(state, DRIVER).select(
        *DRIVER, "compound", "total_laps", "circuit_code", "driver_code",
        F.inline(
            F.array(
                part("now", 1, laps, fresh),
                part("next", 1, 1, F.col("tyre_age_laps")),
                part("next", 2, laps - 1, fresh),
            )
        ),
    )
    sums = project_stints(
        stints.withColumn("segment", F.col("start_lap")), [*DRIVER, "role", "segment"], score
    )

    def total(role: str) -> F.Column:
        return F.sum(F.when(F.col("role") == role, F.col("projected"))) + fixed.PIT_STOP_SECONDS

    return sums.groupBy(*DRIVER).agg(total("now").alias("pit_now"), total("next").alias("pit_next"))


def _faced(pairs: DataFrame, roles: DataFrame, elapsed: DataFrame, now: str, later: str) -> DataFrame:
    held = roles.join(elapsed, list(DRIVER))
    a = held.select("session_id", F.col("driver_id").alias(now), F.col("pit_now").alias("_a"),
                    F.col("elapsed").alias("_ta"))
    b = held.select("session_id", F.col("driver_id").alias(later), F.col("pit_next").alias("_b"),
                    F.col("elapsed").alias("_tb"))
    rows = pairs.join(a, ["session_id", now]).join(b, ["session_id", later])
    mean = F.col("_ta") - F.col("_tb") + F.col("_a") - F.col("_b")
    return rows.select(*pairs.columns, mean.alias("_mu"))


def undercut(pairs: DataFrame, roles: DataFrame, elapsed: DataFrame) -> DataFrame:
    """Chance that driver_id, pitting now, ends ahead of target_driver_id pitting next lap."""
    rows = _faced(pairs, roles, elapsed, "driver_id", "target_driver_id")
    chance = normal_cdf(-F.col("_mu") / NOISE)
    return rows.select(
        *pairs.columns,
        chance.alias("probability"),
        (-F.col("_mu")).alias("projected_gap_seconds"),
        F.when(chance >= 0.5, "PIT NOW").otherwise("STAY OUT").alias("recommended_action"),
        F.lit(fixed.UNDERCUT_LAPS).alias("n_laps_projected"),
    )


def overcut(pairs: DataFrame, roles: DataFrame, elapsed: DataFrame) -> DataFrame:
    """Chance that driver_id keeps position by staying out while target_driver_id pits now."""
    rows = _faced(pairs, roles, elapsed, "target_driver_id", "driver_id")
    return rows.select(
        *pairs.columns,
        (1 - normal_cdf(-F.col("_mu") / NOISE)).alias("probability"),
        F.col("_mu").alias("projected_gap_seconds"),
        F.lit(fixed.UNDERCUT_LAPS).alias("n_laps_projected"),
    )
