"""Ordered columns inside sessions and drivers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock import fixed
from paddock.functions.scalars import is_sc, is_wet
from paddock.operators.aggregates import DRIVER, laps_in_session
from paddock.operators.joins import latest_per
from paddock.operators.lapblocks import attach_per_driver
from paddock.operators.lookups import join_lookup
from paddock.operators.ordered import exact_quantiles, over_order


def session_gaps(laps: DataFrame, time: str = "lap_time_seconds") -> DataFrame:
    """Gap board per session: drivers by total time with gaps to their neighbours.

    A driver's running total at the last timed lap is the sum over timed laps.
    """
    totals = (
        laps.filter(F.col(time).isNotNull())
        .groupBy(*DRIVER)
        .agg(F.max("lap_number").alias("lap_number"), F.sum(time).alias("_total"))
    )
    ordered = over_order(
        totals, ["session_id"], ["_total", "driver_id"],
        rank="position", previous={"_ahead": "_total"}, following={"_behind": "_total"},
    )
    return ordered.select(
        *DRIVER, "lap_number", F.col("position").cast("int").alias("position"),
        F.coalesce(F.col("_total") - F.col("_ahead"), F.lit(0)).alias("gap_to_ahead"),
        F.coalesce(F.col("_behind") - F.col("_total"), F.lit(0)).alias("gap_to_behind"),
    )


def lap_time_delta(
    laps: DataFrame, time: str = "lap_time_seconds", keys: Sequence[str] = DRIVER
) -> DataFrame:
    """Lap time minus the exact median of the driver's laps in the session.

    ``keys`` may add columns, such as the compound, to take medians over fewer laps.
    """
    medians = exact_quantiles(laps, list(keys), time, {"_median": 0.5}, largest={"last_lap": "lap_number"})
    joined = attach_per_driver(laps, medians, keys)
    return joined.select(*laps.columns, (F.col(time) - F.col("_median")).alias("lap_time_delta"))


def impute_weather(laps: DataFrame, circuit: str = "circuit_id") -> DataFrame:
    """NULL temperatures from the (compound, circuit) mean, else a constant."""
    means = laps.groupBy("compound", circuit).agg(
        F.avg("track_temp").alias("_track"), F.avg("air_temp").alias("_air")
    )
    rows = join_lookup(laps, means, ["compound", circuit])
    kept = [c for c in laps.columns if c not in ("track_temp", "air_temp")]
    return rows.select(
        *kept,
        F.coalesce("track_temp", "_track", F.lit(fixed.DEFAULT_TRACK_TEMP)).cast("double").alias("track_temp"),
        F.coalesce("air_temp", "_air", F.lit(fixed.DEFAULT_AIR_TEMP)).cast("double").alias("air_temp"),
    )


def lap_flags(laps: DataFrame) -> DataFrame:
    """Safety-car onset and wet-track flags, rows ordered by (lap, driver) in a session."""
    active = laps.withColumn("_active", is_sc("track_status"))
    seen = over_order(active, ["session_id"], ["lap_number", "driver_id"], previous={"_before": "_active"})
    return seen.select(
        *laps.columns,
        (F.col("_active") & ~F.coalesce("_before", F.lit(False))).alias("is_sc_event"),
        is_wet("compound").alias("wet_track"),
    )


def capped(gap: Column, cap: float) -> Column:
    """Gap limited to [0, cap]; no neighbour gives the cap."""
    return F.least(F.greatest(F.coalesce(gap, F.lit(cap)), F.lit(0)), F.lit(cap))


def rank_and_gaps(df: DataFrame, group: Sequence[str], time: str, tie: str = "driver_id",
                  cap: float = fixed.MAX_GAP_SECONDS) -> DataFrame:
    """Rank by cumulative time in each group with capped gaps to the neighbours."""
    ordered = over_order(
        df, list(group), [time, tie], rank="rank", previous={"_a": time}, following={"_b": time}
    )
    return ordered.select(
        *df.columns, F.col("rank").cast("int").alias("rank"),
        capped(F.col(time) - F.col("_a"), cap).alias("gap_to_car_ahead"),
        capped(F.col("_b") - F.col(time), cap).alias("gap_to_car_behind"),
    )


def position_context(laps: DataFrame, wanted: DataFrame | None = None,
                     time: str = "lap_time_seconds", cap: float = fixed.MAX_GAP_SECONDS) -> DataFrame:
    """Position, neighbours and capped gaps from every driver's latest lap.

    Gaps compare the drivers' own elapsed times.  ``wanted`` rows (session_id, driver_id)
    without a placed lap go to the back of the field.
    """
    placed = _elapsed_latest(laps, time).filter("position is not null").select(
        *DRIVER, "position", "_run"
    )
    ordered = over_order(
        placed, ["session_id"], ["position", "driver_id"],
        previous={"_at": "_run", "ahead_driver_id": "driver_id"},
        following={"_bt": "_run", "behind_driver_id": "driver_id"},
    )
    field = ordered.select(
        *DRIVER, "position",
        capped(F.col("_run") - F.col("_at"), cap).alias("gap_to_car_ahead"),
        capped(F.col("_bt") - F.col("_run"), cap).alias("gap_to_car_behind"),
        "ahead_driver_id", "behind_driver_id",
    )
    if wanted is None:
        return field
    sizes = placed.groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    asked = join_lookup(wanted.select(*DRIVER).distinct(), sizes, ["session_id"])
    last = F.coalesce("_n", F.lit(0)) + 1
    return asked.join(field, list(DRIVER), "left").select(
        *DRIVER,
        F.coalesce("position", last).alias("position"),
        F.coalesce("gap_to_car_ahead", F.lit(cap)).alias("gap_to_car_ahead"),
        F.coalesce("gap_to_car_behind", F.lit(cap)).alias("gap_to_car_behind"),
        "ahead_driver_id", "behind_driver_id",
    )


def _elapsed_latest(laps: DataFrame, time: str) -> DataFrame:
    """Each driver's latest lap with the driver's elapsed time."""
    totals = laps.groupBy(*DRIVER).agg(F.coalesce(F.sum(time), F.lit(0)).alias("_run"))
    return latest_per(laps, DRIVER, ["lap_number"]).join(totals, list(DRIVER))


def adjacent_pairs(latest: DataFrame) -> DataFrame:
    """(trailing, ahead) drivers next to each other in position order."""
    rows = latest.filter("position is not null").select(*DRIVER, "position")
    ordered = over_order(
        rows, ["session_id"], ["position", "driver_id"], previous={"ahead_driver_id": "driver_id"}
    )
    return ordered.filter("ahead_driver_id is not null").select(
        "session_id", F.col("driver_id").alias("trailing_driver_id"), "ahead_driver_id"
    )


def progress_features(laps: DataFrame) -> DataFrame:
    """Laps to the race end and current tyre age."""
    return laps_in_session(laps).select(
        *laps.columns, "laps_in_session",
        (F.col("laps_in_session") - F.col("lap_number")).alias("laps_to_race_end"),
        F.col("tyre_age_laps").alias("current_tyre_age"),
    )
