"""Joins over laps, stints, weather, contracts and subscriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock import fixed
from paddock.functions.scalars import col
from paddock.operators.lapblocks import attach_per_driver, block_of, running_by_lap
from paddock.operators.lookups import join_lookup, salted_join
from paddock.operators.ordered import over_order
from paddock.operators.reshape import top_k

LAP_KEYS = ("session_id", "driver_id", "lap_number")
STINT_BLOCK = 64


def with_context(
    df: DataFrame, sessions: DataFrame, races: DataFrame, circuits: DataFrame
) -> DataFrame:
    """Add season, round, circuit and session type to rows with a session_id (inner)."""
    dims = (
        sessions.select(F.col("id").alias("session_id"), "race_id", "session_type")
        .join(
            races.select(F.col("id").alias("race_id"), "season", "round_number", "circuit_id"),
            "race_id",
        )
        .join(
            circuits.select(F.col("id").alias("circuit_id"), F.col("name").alias("circuit_name")),
            "circuit_id",
        )
        .select(
            "session_id", "season", "round_number", "circuit_id", "circuit_name", "session_type"
        )
    )
    return join_lookup(df, dims, ["session_id"], "inner")


def latest_per(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], where: Column | None = None
) -> DataFrame:
    """Last row per group; ``where`` is applied to the rows picked, not before."""
    last = top_k(df, keys, [col(o).desc() for o in order], 1)
    return last if where is None else last.filter(where)


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """Latest prediction per driver inside each session, ties by id."""
    return latest_per(predictions, ["session_id", "driver_id"], ["predicted_at", "id"])


def gap_features(
    laps: DataFrame, time: str = "lap_time_seconds", cap: float = fixed.MAX_GAP_SECONDS
) -> DataFrame:
    """Gap to the cars one place ahead and behind on the same lap, capped.

    Laps without a position are dropped first.  A lap without a time has no running
    time, so gaps that need it take the cap.
    """
    placed = laps.filter(F.col("position").isNotNull())
    timed = running_by_lap(placed, {"_run": time})
    timed = timed.withColumn("_run", F.when(F.col(time).isNotNull(), F.col("_run")))
    by_place = timed.select("session_id", "lap_number", "position", F.col("_run").alias("_other"))
    ahead = by_place.withColumn("position", F.col("position") + 1).withColumnRenamed("_other", "_ahead")
    behind = by_place.withColumn("position", F.col("position") - 1).withColumnRenamed("_other", "_behind")
    on = ["session_id", "lap_number", "position"]
    joined = timed.join(ahead, on, "left").join(behind, on, "left")

    limit = F.lit(cap)

    def clip(gap: Column) -> Column:
        return F.least(F.greatest(F.coalesce(gap, limit), F.lit(0)), limit)

    return joined.select(
        *laps.columns,
        clip(F.col("_run") - F.col("_ahead")).alias("gap_to_car_ahead"),
        clip(F.col("_behind") - F.col("_run")).alias("gap_to_car_behind"),
    )


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    left_id: Sequence[str],
    right_id: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Attach to each left row the right row closest in time, inside each ``by`` group.

    Equal distances take the earlier right row; rows with a NULL time are dropped; there
    is no tolerance.  The ids make row order unique, so that even rows of one instant can
    be split over tasks.  Right columns must not share names
    with left ones, except for ``by``.
    """
    by = list(by)
    carried = [c for c in right.columns if c not in by]
    sample = F.struct(F.col(right_on).alias("_at"), *carried)
    rows = left.filter(F.col(left_on).isNotNull()).select(
        *by, F.col(left_on).alias("_t"), F.lit(1).alias("_side"),
        *[F.col(c).alias(f"_l{i}") for i, c in enumerate(left_id)], F.struct(*left.columns).alias("_row"),
    )
    samples = right.filter(F.col(right_on).isNotNull()).select(
        *by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"),
        *[F.col(c).alias(f"_r{i}") for i, c in enumerate(right_id)], sample.alias("_sample"),
    )
    both = rows.unionByName(samples, allowMissingColumns=True)
    ids = [f"_r{i}" for i in range(len(right_id))] + [f"_l{i}" for i in range(len(left_id))]
    order = ["_t", "_side", *ids]
    scanned = over_order(
        both, by, order, last_known={"_before": "_sample"}, next_known={"_after": "_sample"}
    ).filter("_side = 1")
    back = _micros("_t") - _micros("_before._at")
    ahead = _micros("_after._at") - _micros("_t")
    near = F.when(ahead.isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    return scanned.select("_row.*", near.alias("_near")).select(
        *left.columns, *[F.col(f"_near.{c}").alias(c) for c in carried]
    )


def _micros(name: str) -> Column:
    """Position of a timestamp or number on the time axis."""
    return F.unix_micros(F.col(name).cast("timestamp"))


def laps_in_stints(
    laps: DataFrame, stints: DataFrame, time: str = "lap_time_seconds", block: int = STINT_BLOCK
) -> DataFrame:
    """Valid timed laps inside each stint; a stint without an end is its first lap only.

    Both sides meet on (session, driver, block of laps), so neither a long race nor a
    driver with very many laps makes a large join group.
    """
    end = F.coalesce(F.col("end_lap"), F.col("start_lap"))
    spans = (
        stints.select("session_id", "driver_id", "stint_number", "start_lap", end.alias("_end"))
        .filter("_end >= start_lap")
        .withColumn(
            "_block",
            F.explode(F.sequence(block_of("start_lap", block), block_of("_end", block))),
        )
    )
    timed = laps.filter(F.col("is_valid") & F.col(time).isNotNull()).select(
        "session_id", "driver_id", "lap_number", F.col(time), block_of("lap_number", block).alias("_block")
    )
    inside = F.col("lap_number").between(F.col("start_lap"), F.col("_end"))
    return (
        timed.join(spans, ["session_id", "driver_id", "_block"])
        .filter(inside)
        .select("session_id", "driver_id", "stint_number", "lap_number", time)
    )


def label_pit_laps(laps: DataFrame, stints: DataFrame) -> DataFrame:
    """did_pit_this_lap: the lap starts a stint other than the driver's first."""
    first = stints.groupBy("session_id", "driver_id").agg(
        F.min("stint_number").alias("_first"), F.max("start_lap").alias("last_lap")
    )
    stops = (
        attach_per_driver(stints, first, lap="start_lap", how="inner")
        .filter("stint_number > _first")
        .select("session_id", "driver_id", F.col("start_lap").alias("lap_number"))
        .distinct()
        .withColumn("_pit", F.lit(True))
    )
    joined = laps.join(stops, list(LAP_KEYS), "left")
    return joined.select(*laps.columns, F.col("_pit").isNotNull().alias("did_pit_this_lap"))


def match_subscriptions(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events with driver_id and alert_type paired with the subscriptions that hold both.

    A plain join: a live batch is small and is broadcast; in a large one the followers of one
    driver are the skewed side, which the adaptive planner splits.
    """
    wanted = (
        subscriptions.select(
            "user_id", F.explode(F.array_distinct("driver_ids")).alias("driver_id"), "alert_types"
        )
        .select("user_id", "driver_id", F.explode(F.array_distinct("alert_types")).alias("alert_type"))
        .distinct()
    )
    return events.join(wanted, ["driver_id", "alert_type"])


def teammates(contracts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Drivers who share the team and season of each wanted (driver_id, season)."""
    asked = wanted.select("driver_id", "season").join(contracts, ["driver_id", "season"])
    mates = contracts.select("team_id", "season", F.col("driver_id").alias("teammate_id"))
    return (
        salted_join(mates, asked, ["team_id", "season"], "inner")
        .filter("teammate_id <> driver_id")
        .select("driver_id", "season", "team_id", "teammate_id")
    )


def map_cars(df: DataFrame, car_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a driver_id, rows whose car number is not mapped)."""
    joined = join_lookup(df, car_map.select("car_number", "driver_id"), ["car_number"])
    return joined.filter("driver_id is not null"), joined.filter("driver_id is null").drop("driver_id")


def nest_races(races: DataFrame, circuits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Race rows with a circuit struct and an array of sessions ordered by id."""
    session = F.struct("id", "session_type", "session_date")
    held = sessions.groupBy(F.col("race_id").alias("_race")).agg(
        F.array_sort(F.collect_list(session)).alias("sessions")
    )
    circuit = circuits.select(F.col("id").alias("_circuit"), F.struct(*circuits.columns).alias("circuit"))
    empty = F.array().cast(held.schema["sessions"].dataType)
    return (
        races.join(circuit, races["circuit_id"] == circuit["_circuit"], "left")
        .join(held, races["id"] == held["_race"], "left")
        .select(*races.columns, "circuit", F.coalesce("sessions", empty).alias("sessions"))
    )


def nest_drivers(drivers: DataFrame, contracts: DataFrame, teams: DataFrame) -> DataFrame:
    """Driver rows with an array of contracts, each holding its team."""
    team = teams.select(F.col("id").alias("team_id"), F.struct(*teams.columns).alias("team"))
    rows = join_lookup(contracts, team, ["team_id"])
    held = rows.groupBy(F.col("driver_id").alias("_driver")).agg(
        F.array_sort(F.collect_list(F.struct("season", "id", "team"))).alias("contracts")
    )
    empty = F.array().cast(held.schema["contracts"].dataType)
    return drivers.join(held, drivers["id"] == held["_driver"], "left").select(
        *drivers.columns, F.coalesce("contracts", empty).alias("contracts")
    )


def nest_laps(laps: DataFrame, sector_times: DataFrame) -> DataFrame:
    """Lap rows with their sector times; laps without any get an empty array."""
    parts = [c for c in sector_times.columns if c not in ("id", "lap_data_id", "sector")]
    held = sector_times.groupBy(F.col("lap_data_id").alias("_lap")).agg(
        F.array_sort(F.collect_list(F.struct("sector", *parts))).alias("sector_times")
    )
    empty = F.array().cast(held.schema["sector_times"].dataType)
    return laps.join(held, laps["id"] == held["_lap"], "left").select(
        *laps.columns, F.coalesce("sector_times", empty).alias("sector_times")
    )
