"""Driver state, stint projection and tyre life.

``score`` is any function that takes a DataFrame with the tyre feature columns and
returns it with a ``prediction`` column: a fitted model's transform or a formula.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock import fixed
from paddock.functions.scalars import compound_code, compound_model, forward_fuel
from paddock.operators.aggregates import DRIVER, race_length
from paddock.operators.joins import latest_per
from paddock.operators.lookups import join_lookup

Score = Callable[[DataFrame], DataFrame]
STATE = (
    "session_id", "driver_id", "lap_number", "compound", "tyre_age_laps", "position",
    "total_laps", "circuit_code", "driver_code",
)
_STEP = 1024


def current_state(laps: DataFrame, context: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Latest lap of each driver with race length and circuit.

    ``context`` has session_id, circuit_id and circuit_code; ``codes`` maps driver_id to
    driver_code.
    """
    last = latest_per(laps, DRIVER, ["lap_number"]).select(
        *DRIVER, "lap_number", "compound", "tyre_age_laps", "position"
    )
    lengths = race_length(laps).withColumnRenamed("laps_in_session", "_length")
    rows = join_lookup(join_lookup(last, lengths, ["session_id"]), context, ["session_id"])
    rows = rows.withColumn("total_laps", F.coalesce("_length", "lap_number")).drop("_length")
    if codes is not None:
        return join_lookup(rows, codes, ["driver_id"])
    return rows


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash rows over all shuffle partitions before they are multiplied.

    The row count is small here, so the adaptive planner would otherwise merge the
    partitions and one task would do all of the expansion.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def count_up(df: DataFrame, n: str, out: str) -> DataFrame:
    """Repeat each row for 0..n-1; no rows when n <= 0.

    Numbers come in steps, so no single array grows with ``n``.
    """
    steps = df.filter(F.col(n) > 0).withColumn(
        "_step", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / _STEP).cast("int")))
    )
    first = F.col("_step") * _STEP
    last = F.least(first + _STEP, F.col(n)) - 1
    return steps.withColumn(out, F.explode(F.sequence(first, last.cast("int")))).drop("_step")


def expand_stint(df: DataFrame) -> DataFrame:
    """One feature row per future lap of each stint.

    Input: start_lap, n_laps, start_age, total_laps, compound, circuit_code, driver_code.
    All other columns are kept as they are.
    """
    used = ("start_lap", "n_laps", "start_age", "total_laps", "compound", "circuit_code", "driver_code")
    kept = [c for c in df.columns if c not in used]
    rows = count_up(df, "n_laps", "_i")
    lap = F.col("start_lap") + F.col("_i")
    return rows.select(
        *kept,
        lap.alias("lap_number"),
        compound_code("compound").alias("compound_encoded"),
        (F.col("start_age") + F.col("_i")).alias("tyre_age_laps"),
        forward_fuel(lap, "total_laps").alias("fuel_adjusted_time"),
        F.col("circuit_code").alias("circuit_id_encoded"),
        F.col("driver_code").alias("driver_id_encoded"),
        compound_model("compound").alias("tyre_model"),
    )


def score_stints(df: DataFrame, keys: Sequence[str], score: Score) -> DataFrame:
    """One row per lap of each stint with lap_number and ``delta``, a row of 0 for stints without laps."""
    keys = list(keys)
    rows = df.select(
        *keys, "start_lap", F.greatest("n_laps", F.lit(1)).alias("n_laps"), "start_age",
        "total_laps", "compound", "circuit_code", "driver_code",
        (F.col("n_laps") > 0).alias("_run"),
    )
    delta = F.when(F.col("_run"), F.col("prediction").cast("double")).otherwise(0.0)
    return score(expand_stint(rows)).select(*keys, "lap_number", delta.alias("delta"))


def stint_deltas(df: DataFrame, keys: Sequence[str], score: Score, summed: Column) -> DataFrame:
    """As ``score_stints``; a score that can sum gives the ``summed`` stints as one row each, without a lap number."""
    whole = getattr(score, "stints", None)
    return whole(df, keys, summed) if whole else score_stints(df, keys, score)


def project_stints(df: DataFrame, keys: Sequence[str], score: Score) -> DataFrame:
    """Sum of predicted deltas per stint key, 0 for stints without laps.

    Every stint is expanded where it is and summed before rows move.
    """
    return score_stints(df, keys, score).groupBy(*keys).agg(F.sum("delta").alias("projected"))


def life_remaining(df: DataFrame, keys: Sequence[str], score: Score) -> DataFrame:
    """Laps until the predicted delta reaches the threshold, at most 40.

    ``df`` has the tyre feature columns; fuel stays at its current value.
    """
    moving = ("lap_number", "tyre_age_laps")
    routed = ["tyre_model"] if "tyre_model" in df.columns else []
    ahead = df.select(
        F.struct(*keys).alias("_key"), F.struct(*fixed.TYRE_FEATURES).alias("_now"), *routed,
        F.explode(F.sequence(F.lit(0), F.lit(fixed.LIFE_LAPS - 1))).alias("_off"),
    )
    rows = ahead.select(
        "_key", "_off", *routed,
        *[
            (F.col(f"_now.{f}") + F.col("_off") if f in moving else F.col(f"_now.{f}")).alias(f)
            for f in fixed.TYRE_FEATURES
        ],
    )
    crossed = F.when(F.col("prediction") >= fixed.DEGRADED_SECONDS, F.col("_off"))
    lives = score(rows).groupBy("_key").agg(
        F.coalesce(F.min(crossed), F.lit(fixed.LIFE_LAPS)).cast("int").alias("life_remaining")
    )
    return lives.select("_key.*", "life_remaining")
