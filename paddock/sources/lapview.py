"""Lap tables derived from the events table.

Every event becomes one lap: the user is the driver, ten days are a session, the value
sets the lap time.  Times are integer milliseconds, so sums do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.operators.ordered import over_order, ranked
from paddock.scratch import new_path
from paddock.session import configure

_TABLES: dict[tuple[str, str, str], str] = {}


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def _once(spark: SparkSession, root: str, name: str, build) -> DataFrame:
    """Build a derived table once per application and folder, then read it."""
    key = (spark.sparkContext.applicationId, root, name)
    if key not in _TABLES:
        path = new_path(spark, name)
        build().write.parquet(path)
        _TABLES[key] = path
    return spark.read.parquet(_TABLES[key])


def _code() -> F.Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def _session() -> F.Column:
    return F.floor((F.dayofmonth("ts") - 1) / 10).cast("int")


def laps(spark: SparkSession, root: str) -> DataFrame:
    return _once(spark, root, "laps", lambda: _build_laps(spark, root))


def _build_laps(spark: SparkSession, root: str) -> DataFrame:
    events = read(spark, root, "events").select(
        _session().alias("session_id"),
        F.col("user_id").alias("driver_id"),
        "ts",
        "event_id",
        _code().alias("k"),
        (F.lit(60000) + F.round(F.col("value") * 100).cast("bigint") * 10).alias("raw_ms"),
    )
    numbered = over_order(
        events, ["session_id", "driver_id"], ["ts", "event_id"],
        rank="lap_number", sums={"cum_ms": "raw_ms"},
    ).withColumn("lap_number", F.col("lap_number").cast("int"))
    placed = ranked(
        numbered, ["session_id", "lap_number"], ["cum_ms", "driver_id"], "place"
    )
    k, raw = F.col("k"), F.col("raw_ms")
    stint_laps = 5 + F.col("driver_id") % 4
    s1 = F.floor(raw * 0.3).cast("bigint") + k * 10
    s2 = F.floor(raw * 0.4).cast("bigint")
    staged = placed.withColumn(
        "stint_number", F.floor((F.col("lap_number") - 1) / stint_laps).cast("int") + 1
    )
    turn = (F.col("driver_id") + F.col("stint_number")) % 5
    return staged.select(
        "session_id",
        "driver_id",
        "lap_number",
        "stint_number",
        F.when(k % 31 != 0, raw).alias("lap_ms"),
        F.when(k % 17 != 0, s1).alias("sector1_ms"),
        s2.alias("sector2_ms"),
        (raw - s1 - s2).alias("sector3_ms"),
        F.when(turn == 0, "SOFT").when(turn == 1, "MEDIUM").when(turn == 2, "HARD")
        .when(turn == 3, "INTERMEDIATE").otherwise("WET").alias("compound"),
        ((F.col("lap_number") - 1) % stint_laps).cast("int").alias("tyre_age_laps"),
        (k % 11 != 0).alias("is_valid"),
        F.when(k % 23 != 0, F.col("place").cast("int")).alias("position"),
        F.when(k % 20 == 0, "4").when(k % 20 == 1, "24").when(k % 20 == 2, "67")
        .when(k % 20 != 3, "1").alias("track_status"),
        F.when(k % 10 != 3, 20 + k % 30).alias("track_temp"),
        F.when(k % 10 != 4, 15 + k % 15).alias("air_temp"),
        F.col("ts").alias("created_at"),
    )


def stints(spark: SparkSession, root: str) -> DataFrame:
    def build() -> DataFrame:
        open_end = (F.col("driver_id") % 7 == 0) & (F.col("stint_number") > 1)
        return (
            laps(spark, root)
            .groupBy("session_id", "driver_id", "stint_number")
            .agg(
                F.min("compound").alias("compound"),
                F.min("lap_number").alias("start_lap"),
                F.max("lap_number").alias("last_lap"),
            )
            .withColumn("end_lap", F.when(~open_end, F.col("last_lap")))
            .drop("last_lap")
        )

    return _once(spark, root, "stints", build)


def context(spark: SparkSession, root: str) -> DataFrame:
    def build() -> DataFrame:
        even = F.col("session_id") % 2 == 0
        return laps(spark, root).select("session_id").distinct().select(
            "session_id",
            (F.lit(2023) + F.col("session_id")).alias("season"),
            F.when(even, 0).otherwise(1).alias("circuit_id"),
            F.when(even, "Circuit de Monaco").otherwise("Silverstone Circuit").alias("circuit_name"),
        )

    return _once(spark, root, "context", build)


def contracts(spark: SparkSession, root: str) -> DataFrame:
    """One contract per driver and season; every session here is a season of its own."""

    def build() -> DataFrame:
        seasons = context(spark, root).agg(F.array_sort(F.collect_set("season"))).scalar()
        drivers = laps(spark, root).select("driver_id").distinct().filter("driver_id % 13 <> 0")
        return drivers.select(
            "driver_id",
            (F.col("driver_id") % 10).alias("team_id"),
            F.explode(seasons).alias("season"),
        )

    return _once(spark, root, "contracts", build)


def weather_samples(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "events").filter("event_type = 'view'").select(
        _session().alias("session_id"),
        F.col("ts").alias("sample_ts"),
        F.col("event_id").alias("sample_id"),
        (20 + _code() % 30).alias("track_temp"),
        (15 + _code() % 15).alias("air_temp"),
    )


def request_log(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "events").select(
        "event_id",
        "ts",
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("value") / 25.0).alias("latency_s"),
        (_code() % 3 != 0).alias("cache_hit"),
        F.concat(F.lit("live:2025:"), F.col("user_id").cast("string"), F.lit(":gaps")).alias("cache_key"),
    )
