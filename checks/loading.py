"""Sources, upserts, dimensions and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import query
from checks.relational import DRIVER, LAP
from checks.strategy import OVERVIEW_SQL, WINDOW_SQL, pit_score, rounded, state, tyre_score
from checks.values import lap_records
from paddock.plans import pitstops
from paddock.scratch import new_path
from paddock.sources import ingest
from paddock.sources import lapview as v

RECORD_SQL = """
SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(driver_id AS VARCHAR) AS driver_id, lap_number, ROUND(lap_ms / 1000.0, 6) AS lap_time_seconds, compound, tyre_age_laps, is_valid, position, track_status FROM laps
"""
RECORD = ("session_id", "driver_id", "lap_number", "lap_time_seconds", "compound", "tyre_age_laps", "is_valid", "position", "track_status")


def _read_table(fmt: str):
    def run(spark, root) -> DataFrame:
        folder = new_path(spark, "tables")
        rows = lap_records(spark, root).withColumn("id", F.concat_ws("-", "session_id", "driver_id", "lap_number"))
        names = [f.split()[0] for f in ingest.TABLES["lap_data"].split(", ")]
        writer = rows.select(*names).write
        if fmt == "csv":
            writer = writer.option("header", "true")
        writer.format(fmt).save(f"{folder}/lap_data.{fmt}")
        return ingest.read_table(spark, folder, "lap_data", fmt).select(*RECORD)

    return run


for _fmt in ("parquet", "csv", "json", "orc"):
    query(f"s01_read_{_fmt}", RECORD_SQL)(_read_table(_fmt))


def raw_laps(spark, root) -> DataFrame:
    """Feed laps: codes instead of ids, intervals instead of seconds, some rows incomplete."""
    lap = F.col("lap_number")

    def took(c: str):
        return F.make_dt_interval(secs=F.col(c) / 1000.0)

    return v.laps(spark, root).select(
        F.col("session_id"), F.concat(F.lit("D"), F.col("driver_id").cast("string")).alias("Driver"),
        F.when(lap % 19 != 0, F.when(lap % 23 == 0, float("nan")).otherwise(lap.cast("double"))).alias("LapNumber"), took("lap_ms").alias("LapTime"),
        took("sector1_ms").alias("Sector1Time"), took("sector2_ms").alias("Sector2Time"), took("sector3_ms").alias("Sector3Time"),
        F.when(lap % 4 != 0, F.col("compound")).alias("Compound"), F.when(lap % 5 != 0, F.when(lap % 7 == 0, float("nan")).otherwise(F.col("tyre_age_laps").cast("double"))).alias("TyreLife"),
        F.when(lap % 6 != 0, F.col("is_valid")).alias("IsAccurate"), F.when(lap % 8 == 0, float("nan")).otherwise(F.col("position").cast("double")).alias("Position"),
        F.col("track_status").alias("TrackStatus"), F.col("stint_number").cast("double").alias("Stint"), took("sector2_ms").alias("Time"),
    )


@query("s02_normalize_laps", """
SELECT session_id, driver_id, lap_number, ROUND(lap_ms / 1000.0, 6) AS lap_time_seconds, ROUND(sector1_ms / 1000.0, 6) AS sector1_seconds,
  CASE WHEN lap_number % 4 = 0 THEN 'UNKNOWN' ELSE compound END AS compound, CASE WHEN lap_number % 5 = 0 OR lap_number % 7 = 0 THEN 0 ELSE tyre_age_laps END AS tyre_age_laps,
  CASE WHEN lap_number % 6 = 0 THEN FALSE ELSE is_valid END AS is_valid, CASE WHEN lap_number % 8 <> 0 THEN position END AS position, track_status, NULL AS reason FROM laps
WHERE driver_id % 13 <> 0 AND lap_number % 19 <> 0 AND lap_number % 23 <> 0
UNION ALL SELECT session_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN driver_id % 13 = 0 THEN 'unmapped driver' ELSE 'no lap number' END FROM laps WHERE driver_id % 13 = 0 OR lap_number % 19 = 0 OR lap_number % 23 = 0
""")
def s02(spark, root):
    drivers = v.contracts(spark, root).select("driver_id").distinct().select(
        F.col("driver_id").alias("id"), F.concat(F.lit("D"), F.col("driver_id").cast("string")).alias("code")
    )
    laps, rejects = ingest.normalize_laps(raw_laps(spark, root), drivers)
    good = laps.select(*LAP, "lap_time_seconds", "sector1_seconds", "compound", "tyre_age_laps", "is_valid", "position", "track_status")
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(
        rejects.select("session_id", "reason"), allowMissingColumns=True
    )


LINE = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("s03_append_new", """
, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM r WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM lineitem t WHERE t.l_returnflag = 'R' AND t.l_orderkey = r.l_orderkey AND t.l_linenumber = r.l_linenumber)
""")
def s03(spark, root):
    lines = v.read(spark, root, "lineitem")
    fresh = ingest.append_new(lines.filter("l_returnflag = 'R'"), lines, LINE, LINE_ORDER)
    return fresh.select(*LINE, "l_partkey", "l_suppkey", "l_quantity")


@query("s04_update_matched", """
SELECT session_id, driver_id, lap_number, CASE WHEN lap_number % 3 = 0 THEN CASE WHEN lap_number % 2 = 0 THEN NULL ELSE 99 END ELSE position END AS position, CASE WHEN lap_number % 3 = 0 THEN 'x' ELSE track_status END AS track_status FROM laps
""")
def s04(spark, root):
    held = v.laps(spark, root)
    updates = held.filter("lap_number % 3 = 0").select(
        *LAP, F.when(F.col("lap_number") % 2 != 0, 99).alias("position"), F.lit("x").alias("track_status")
    )
    unknown = updates.withColumn("lap_number", F.col("lap_number") + 10_000_000)
    rows = ingest.update_matched(held, updates.unionByName(unknown), LAP, ["position", "track_status"])
    return rows.select(*LAP, "position", "track_status")


@query("s05_ensure_dim", """
SELECT CASE WHEN c_custkey % 3 = 0 THEN 'old-' || c_custkey ELSE sha256('{"name":"' || c_name || '"}') END AS id, c_name AS name FROM customer
""")
def s05(spark, root):
    people = v.read(spark, root, "customer").select("c_custkey", F.col("c_name").alias("name"))
    existing = people.filter("c_custkey % 3 = 0").select(F.concat(F.lit("old-"), F.col("c_custkey").cast("string")).alias("id"), "name")
    incoming = people.select("name")
    return ingest.ensure_dim(existing, incoming.unionByName(incoming), ["name"])


PLACES = ("Monaco", "Silverstone", "Miami", "Miami Gardens", "Nowhere", "Baku", "São Paulo")


@query("s06_map_circuits", """
, rounds AS (SELECT o_orderkey AS round_number, ['Monaco', 'Silverstone', 'Miami', 'Miami Gardens', 'Nowhere', 'Baku', 'São Paulo'][o_custkey % 7 + 1] AS location FROM orders),
seeded AS (SELECT * FROM (VALUES ('Monaco', 7), ('Silverstone', 11), ('Miami', 5), ('Miami Gardens', 5)) t(location, circuit_id))
SELECT round_number, r.location, CAST(circuit_id AS INT) AS circuit_id, CASE WHEN r.location = 'Nowhere' THEN 'unknown location' WHEN circuit_id IS NULL THEN 'circuit not seeded' END AS reason FROM rounds r LEFT JOIN seeded s ON s.location = r.location
""")
def s06(spark, root):
    from paddock.fixed import CIRCUITS

    places = F.array(*[F.lit(p) for p in PLACES])
    rounds = v.read(spark, root, "orders").select(
        F.col("o_orderkey").alias("round_number"), F.element_at(places, (F.col("o_custkey") % 7 + 1).cast("int")).alias("location")
    )
    circuits = spark.createDataFrame([(i, row[0]) for i, row in enumerate(CIRCUITS) if i < 16], "id int, name string")
    mapped, rejected = ingest.map_circuits(rounds, circuits)
    return mapped.drop("circuit_name").unionByName(rejected, allowMissingColumns=True).select("round_number", "location", "circuit_id", "reason")


@query("s07_load_season", """
SELECT CAST(session_id + 1 AS INT) AS round_number, COUNT(*) AS laps, CAST(COALESCE(SUM(lap_ms), 0) AS BIGINT) AS total_ms FROM laps WHERE session_id <> 1 GROUP BY 1
UNION ALL SELECT CAST(i AS INT), 0, 0 FROM range(2, 25) t(i) WHERE i <> 3
""")
def s07(spark, root):
    """Round 2 has good files and one that is no Parquet; rounds from 4 on are missing."""
    folder = new_path(spark, "season")
    season = f"{folder}/season=2025/session_type=R"
    rows = raw_laps(spark, root).withColumn("round_number", F.col("session_id") + 1).drop("session_id")
    rows.write.partitionBy("round_number").parquet(season)
    broken = f"{season}/round_number=2"
    spark.range(3).selectExpr("'no lap at all' AS value").coalesce(1).write.mode("append").text(broken)
    raw, missing = ingest.load_season(spark, folder, 2025)
    from paddock.functions.scalars import interval_seconds

    read = raw.groupBy("round_number").agg(
        F.count(F.lit(1)).alias("laps"), F.round(F.sum(interval_seconds("LapTime")) * 1000).cast("bigint").alias("total_ms")
    )
    return read.unionByName(missing.select("round_number", F.lit(0).cast("bigint").alias("laps"), F.lit(0).cast("bigint").alias("total_ms")))


def _stored(spark, root) -> str:
    held = state(spark, root)
    path = new_path(spark, "strategy")
    ingest.build_strategy_tables(
        pitstops.pit_windows(held, tyre_score), pitstops.strategy_overview(held, tyre_score, pit_score), path
    )
    return path


@query("s12_stored_pit_windows", WINDOW_SQL + """
SELECT session_id, driver_id, CAST(pit_lap AS INT) AS pit_lap, ROUND(t, 8) AS projected_total_delta_seconds FROM windows WHERE r <= 3
""")
def s12(spark, root):
    rows = spark.read.parquet(f"{_stored(spark, root)}/pit_windows")
    return rounded(rows, "projected_total_delta_seconds").select(*DRIVER, "pit_lap", "projected_total_delta_seconds")


@query("s12_stored_overview", OVERVIEW_SQL + "SELECT session_id, driver_id, predicted_pit_lap, ROUND(pit_probability, 8) AS pit_probability FROM overview")
def s12_overview(spark, root):
    return rounded(spark.read.parquet(f"{_stored(spark, root)}/overview"), "pit_probability")
