"""Joins, windows, aggregates, reshaping."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import query
from paddock.operators import aggregates as agg
from paddock.operators import encode, joins, lookups, reshape, windows
from paddock.sources import lapview as v

DRIVER = ["session_id", "driver_id"]
LAP = [*DRIVER, "lap_number"]
SECTORS = ("sector1_ms", "sector2_ms", "sector3_ms")


def secs(name: str):
    return F.round(F.col(name).cast("double") / 1000.0, 6)


def day_text(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


def with_season(spark, root, df: DataFrame) -> DataFrame:
    return lookups.join_lookup(df, v.context(spark, root), ["session_id"], "inner")


@query("w01_session_gaps", """
, totals AS (SELECT session_id, driver_id, MAX(lap_number) AS lap_number, SUM(lap_ms) AS total
  FROM laps WHERE lap_ms IS NOT NULL GROUP BY 1, 2)
SELECT session_id, driver_id, lap_number,
  CAST(ROW_NUMBER() OVER w AS INT) AS position,
  CAST(COALESCE(total - LAG(total) OVER w, 0) AS BIGINT) AS gap_to_ahead_ms,
  CAST(COALESCE((LEAD(total) OVER w) - total, 0) AS BIGINT) AS gap_to_behind_ms
FROM totals WINDOW w AS (PARTITION BY session_id ORDER BY total, driver_id)
""")
def w01(spark, root):
    return windows.session_gaps(v.laps(spark, root), "lap_ms").withColumnsRenamed(
        {"gap_to_ahead": "gap_to_ahead_ms", "gap_to_behind": "gap_to_behind_ms"}
    )


@query("w02_lap_time_delta", """
SELECT session_id, driver_id, lap_number, lap_ms - MEDIAN(lap_ms) OVER (PARTITION BY session_id, driver_id) AS lap_time_delta
FROM laps
""")
def w02(spark, root):
    return windows.lap_time_delta(v.laps(spark, root), "lap_ms").select(*LAP, "lap_time_delta")


@query("w03_impute_weather", """
SELECT l.session_id, driver_id, lap_number,
  ROUND(COALESCE(CAST(track_temp AS DOUBLE), AVG(track_temp) OVER w, 35.0), 6) AS track_temp,
  ROUND(COALESCE(CAST(air_temp AS DOUBLE), AVG(air_temp) OVER w, 25.0), 6) AS air_temp
FROM laps l JOIN context c ON l.session_id = c.session_id WINDOW w AS (PARTITION BY compound, circuit_id)
""")
def w03(spark, root):
    rows = windows.impute_weather(with_season(spark, root, v.laps(spark, root)))
    return rows.select(*LAP, F.round("track_temp", 6).alias("track_temp"), F.round("air_temp", 6).alias("air_temp"))


FLAGS_SQL = """
, active AS (SELECT *, COALESCE(regexp_matches(track_status, '[467]'), FALSE) AS sc FROM laps),
flags AS (SELECT session_id, driver_id, lap_number, sc AND NOT COALESCE(LAG(sc) OVER (PARTITION BY session_id ORDER BY lap_number, driver_id), FALSE) AS is_sc_event,
  compound IN ('INTERMEDIATE', 'WET') AS wet_track FROM active)
"""


@query("w04_lap_flags", FLAGS_SQL + "SELECT * FROM flags")
def w04(spark, root):
    return windows.lap_flags(v.laps(spark, root)).select(*LAP, "is_sc_event", "wet_track")


def totals(spark, root) -> DataFrame:
    return agg.elapsed_time(v.laps(spark, root), time="lap_ms")


@query("w05_rank_and_gaps", """
, t AS (SELECT session_id, driver_id, CAST(COALESCE(SUM(lap_ms), 0) AS BIGINT) AS elapsed FROM laps GROUP BY 1, 2)
SELECT session_id, driver_id, elapsed, CAST(ROW_NUMBER() OVER w AS INT) AS rank,
  ROUND(LEAST(GREATEST(COALESCE(elapsed - LAG(elapsed) OVER w, 120000), 0), 120000) / 1000.0, 6) AS gap_to_car_ahead,
  ROUND(LEAST(GREATEST(COALESCE((LEAD(elapsed) OVER w) - elapsed, 120000), 0), 120000) / 1000.0, 6) AS gap_to_car_behind
FROM t WINDOW w AS (PARTITION BY session_id ORDER BY elapsed, driver_id)
""")
def w05(spark, root):
    rows = windows.rank_and_gaps(totals(spark, root), ["session_id"], "elapsed", cap=120_000)
    return rows.select(*DRIVER, "elapsed", "rank", secs("gap_to_car_ahead").alias("gap_to_car_ahead"),
                       secs("gap_to_car_behind").alias("gap_to_car_behind"))


@query("w06_position_context", """
, last AS (SELECT * FROM (SELECT session_id, driver_id, position,
    ROW_NUMBER() OVER (PARTITION BY session_id, driver_id ORDER BY lap_number DESC) AS r,
    SUM(COALESCE(lap_ms, 0)) OVER (PARTITION BY session_id, driver_id) AS run FROM laps) WHERE r = 1 AND position IS NOT NULL),
field AS (SELECT session_id, driver_id, position,
  LEAST(GREATEST(COALESCE(run - LAG(run) OVER w, 120000), 0), 120000) AS ahead,
  LEAST(GREATEST(COALESCE((LEAD(run) OVER w) - run, 120000), 0), 120000) AS behind,
  LAG(driver_id) OVER w AS ahead_driver_id, LEAD(driver_id) OVER w AS behind_driver_id
  FROM last WINDOW w AS (PARTITION BY session_id ORDER BY position, driver_id)),
sizes AS (SELECT session_id, COUNT(*) AS n FROM last GROUP BY 1)
SELECT d.session_id, d.driver_id, CAST(COALESCE(f.position, s.n + 1) AS INT) AS position,
  ROUND(COALESCE(ahead, 120000) / 1000.0, 6) AS gap_to_car_ahead, ROUND(COALESCE(behind, 120000) / 1000.0, 6) AS gap_to_car_behind,
  ahead_driver_id, behind_driver_id
FROM (SELECT DISTINCT session_id, driver_id FROM laps) d JOIN sizes s USING (session_id) LEFT JOIN field f ON d.session_id = f.session_id AND d.driver_id = f.driver_id
""")
def w06(spark, root):
    held = v.laps(spark, root)
    rows = windows.position_context(held, agg.roster(held), "lap_ms", 120_000)
    return rows.select(*DRIVER, "position", secs("gap_to_car_ahead").alias("gap_to_car_ahead"),
                       secs("gap_to_car_behind").alias("gap_to_car_behind"), "ahead_driver_id", "behind_driver_id")


@query("w07_adjacent_pairs", """
, last AS (SELECT * FROM (SELECT session_id, driver_id, position, ROW_NUMBER() OVER (PARTITION BY session_id, driver_id ORDER BY lap_number DESC) AS r FROM laps)
  WHERE r = 1 AND position IS NOT NULL),
p AS (SELECT session_id, driver_id AS trailing_driver_id, LAG(driver_id) OVER (PARTITION BY session_id ORDER BY position, driver_id) AS ahead_driver_id FROM last)
SELECT * FROM p WHERE ahead_driver_id IS NOT NULL
""")
def w07(spark, root):
    return windows.adjacent_pairs(joins.latest_per(v.laps(spark, root), DRIVER, ["lap_number"]))


@query("w08_progress_features", """
SELECT session_id, driver_id, lap_number, MAX(lap_number) OVER (PARTITION BY session_id) - lap_number AS laps_to_race_end, tyre_age_laps AS current_tyre_age FROM laps
""")
def w08(spark, root):
    return windows.progress_features(v.laps(spark, root)).select(*LAP, "laps_to_race_end", "current_tyre_age")


# Joins


@query("j01_context_star_join", """
SELECT l.session_id, driver_id, lap_number, season, CAST(1 AS INT) + l.session_id AS round_number, circuit_id, circuit_name, 'R' AS session_type
FROM laps l JOIN context c ON l.session_id = c.session_id
""")
def j01(spark, root):
    ctx = v.context(spark, root)
    sessions = ctx.select(
        F.col("session_id").alias("id"), (F.col("session_id") + 100).alias("race_id"), F.lit("R").alias("session_type")
    )
    races = ctx.select(
        (F.col("session_id") + 100).alias("id"), "season", (F.col("session_id") + 1).alias("round_number"), "circuit_id"
    )
    circuits = ctx.select(F.col("circuit_id").alias("id"), F.col("circuit_name").alias("name")).distinct()
    rows = joins.with_context(v.laps(spark, root), sessions, races, circuits)
    return rows.select(*LAP, "season", "round_number", "circuit_id", "circuit_name", "session_type")


@query("j02_latest_lap", """
, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, driver_id ORDER BY lap_number DESC) AS n FROM laps)
SELECT session_id, driver_id, lap_number, compound, tyre_age_laps, position FROM r WHERE n = 1 AND position IS NOT NULL
""")
def j02(spark, root):
    rows = joins.latest_per(v.laps(spark, root), DRIVER, ["lap_number"], F.col("position").isNotNull())
    return rows.select(*LAP, "compound", "tyre_age_laps", "position")


def predictions(spark, root) -> DataFrame:
    """One stored prediction per lap; every second lap shares its time with the one before."""
    return v.laps(spark, root).select(
        *DRIVER, F.col("lap_number").alias("id"),
        F.floor(F.col("lap_number") / 2).cast("int").alias("predicted_at"),
        ((F.col("lap_number") * 37 + F.col("driver_id") * 11) % 100 / 100.0).alias("undercut_score"),
        ((F.col("lap_number") * 17 + F.col("driver_id") * 7) % 100 / 100.0).alias("pit_probability"),
    )


PREDICTIONS_SQL = """
, predictions AS (SELECT session_id, driver_id, lap_number AS id, CAST(FLOOR(lap_number / 2) AS INT) AS predicted_at,
  (lap_number * 37 + driver_id * 11) % 100 / 100.0 AS undercut_score, (lap_number * 17 + driver_id * 7) % 100 / 100.0 AS pit_probability FROM laps)
"""


@query("j03_latest_predictions", PREDICTIONS_SQL + """
SELECT session_id, driver_id, id, predicted_at, undercut_score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, driver_id ORDER BY predicted_at DESC, id DESC) AS r FROM predictions) WHERE r = 1
""")
def j03(spark, root):
    rows = joins.latest_predictions(predictions(spark, root))
    return rows.select(*DRIVER, "id", "predicted_at", F.col("undercut_score").cast("double").alias("undercut_score"))


GAPS_SQL = """
, placed AS (SELECT session_id, driver_id, lap_number, position, compound, tyre_age_laps,
  CASE WHEN lap_ms IS NOT NULL THEN SUM(lap_ms) OVER (PARTITION BY session_id, driver_id ORDER BY lap_number ROWS UNBOUNDED PRECEDING) END AS run
  FROM laps WHERE position IS NOT NULL),
gaps AS (SELECT p.session_id, p.driver_id, p.lap_number, p.position, p.compound, p.tyre_age_laps,
  LEAST(GREATEST(COALESCE(p.run - a.run, 120000), 0), 120000) / 1000.0 AS gap_to_car_ahead,
  LEAST(GREATEST(COALESCE(b.run - p.run, 120000), 0), 120000) / 1000.0 AS gap_to_car_behind
FROM placed p
LEFT JOIN placed a ON a.session_id = p.session_id AND a.lap_number = p.lap_number AND a.position = p.position - 1
LEFT JOIN placed b ON b.session_id = p.session_id AND b.lap_number = p.lap_number AND b.position = p.position + 1)
"""


@query("j04_gap_features", GAPS_SQL + """
SELECT session_id, driver_id, lap_number, position, ROUND(gap_to_car_ahead, 6) AS gap_to_car_ahead, ROUND(gap_to_car_behind, 6) AS gap_to_car_behind FROM gaps
""")
def j04(spark, root):
    rows = joins.gap_features(v.laps(spark, root), "lap_ms", 120_000)
    return rows.select(*LAP, "position", secs("gap_to_car_ahead").alias("gap_to_car_ahead"),
                       secs("gap_to_car_behind").alias("gap_to_car_behind"))


@query("j05_asof_nearest", """
, before AS (SELECT l.session_id, l.driver_id, l.lap_number, l.created_at, w.sample_ts, w.sample_id, w.track_temp, w.air_temp
  FROM laps l ASOF LEFT JOIN (SELECT * FROM weather_samples QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, sample_ts ORDER BY sample_id DESC) = 1) w
  ON l.session_id = w.session_id AND l.created_at >= w.sample_ts),
after AS (SELECT l.session_id, l.driver_id, l.lap_number, w.sample_ts, w.sample_id, w.track_temp, w.air_temp
  FROM laps l ASOF LEFT JOIN (SELECT * FROM weather_samples QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, sample_ts ORDER BY sample_id) = 1) w
  ON l.session_id = w.session_id AND l.created_at < w.sample_ts),
both_sides AS (SELECT b.*, a.sample_id AS a_id, a.track_temp AS a_track, a.air_temp AS a_air,
  b.sample_ts IS NOT NULL AND (a.sample_ts IS NULL OR b.created_at - b.sample_ts <= a.sample_ts - b.created_at) AS take_before
  FROM before b JOIN after a ON a.session_id = b.session_id AND a.driver_id = b.driver_id AND a.lap_number = b.lap_number)
SELECT session_id, driver_id, lap_number, CASE WHEN take_before THEN sample_id ELSE a_id END AS sample_id,
  CASE WHEN take_before THEN track_temp ELSE a_track END AS sample_track, CASE WHEN take_before THEN air_temp ELSE a_air END AS sample_air
FROM both_sides
""")
def j05(spark, root):
    samples = v.weather_samples(spark, root).withColumnsRenamed(
        {"track_temp": "sample_track", "air_temp": "sample_air"}
    )
    rows = joins.asof_nearest(
        v.laps(spark, root).select(*LAP, "created_at"), samples, "created_at", "sample_ts",
        ["driver_id", "lap_number"], ["sample_id"], ["session_id"],
    )
    return rows.select(*LAP, "sample_id", "sample_track", "sample_air")


@query("j06_laps_in_stints", """
SELECT l.session_id, l.driver_id, s.stint_number, l.lap_number, l.lap_ms FROM laps l JOIN stints s
ON l.session_id = s.session_id AND l.driver_id = s.driver_id AND l.lap_number BETWEEN s.start_lap AND COALESCE(s.end_lap, s.start_lap)
WHERE l.is_valid AND l.lap_ms IS NOT NULL
""")
def j06(spark, root):
    return joins.laps_in_stints(v.laps(spark, root), v.stints(spark, root), "lap_ms")


PIT_SQL = """
, stops AS (SELECT session_id, driver_id, start_lap AS lap_number FROM (SELECT *, MIN(stint_number) OVER (PARTITION BY session_id, driver_id) AS f FROM stints) WHERE stint_number > f),
labelled AS (SELECT l.*, EXISTS (SELECT 1 FROM stops s WHERE s.session_id = l.session_id AND s.driver_id = l.driver_id AND s.lap_number = l.lap_number) AS did_pit_this_lap FROM laps l)
"""


@query("j07_label_pit_laps", PIT_SQL + "SELECT session_id, driver_id, lap_number, did_pit_this_lap FROM labelled")
def j07(spark, root):
    return joins.label_pit_laps(v.laps(spark, root), v.stints(spark, root)).select(*LAP, "did_pit_this_lap")


def subscriptions(spark, root) -> DataFrame:
    """Every user with an order follows three drivers; odd users take pit alerts only."""
    c = F.col("c_custkey")
    return v.read(spark, root, "customer").select(
        c.alias("user_id"),
        F.array(c % 50, (c * 7) % 50, (c * 7) % 50).alias("driver_ids"),
        F.when(c % 2 == 1, F.array(F.lit("PIT_WINDOW_OPEN")))
        .otherwise(F.array(F.lit("PIT_WINDOW_OPEN"), F.lit("UNDERCUT_THREAT"))).alias("alert_types"),
    )


SUBSCRIPTIONS_SQL = """
, subs AS (SELECT DISTINCT c_custkey AS user_id, UNNEST([c_custkey % 50, (c_custkey * 7) % 50]) AS driver_id, c_custkey % 2 = 1 AS pit_only FROM customer)
"""


@query("j08_match_subscriptions", SUBSCRIPTIONS_SQL + """
, last AS (SELECT driver_id, COUNT(*) AS laps_seen FROM laps GROUP BY 1)
SELECT l.driver_id, 'UNDERCUT_THREAT' AS alert_type, laps_seen, user_id FROM last l JOIN subs s ON s.driver_id = l.driver_id WHERE NOT pit_only
""")
def j08(spark, root):
    events = v.laps(spark, root).groupBy("driver_id").agg(F.count(F.lit(1)).alias("laps_seen"))
    events = events.withColumn("alert_type", F.lit("UNDERCUT_THREAT"))
    return joins.match_subscriptions(events, subscriptions(spark, root)).select(
        "driver_id", "alert_type", "laps_seen", "user_id"
    )


@query("j09_teammates", """
, lead AS (SELECT team_id, season, MIN(driver_id) AS driver_id FROM contracts GROUP BY 1, 2)
SELECT l.driver_id, l.season, l.team_id, c.driver_id AS teammate_id FROM lead l JOIN contracts c ON c.team_id = l.team_id AND c.season = l.season AND c.driver_id <> l.driver_id
""")
def j09(spark, root):
    held = v.contracts(spark, root)
    leaders = held.groupBy("team_id", "season").agg(F.min("driver_id").alias("driver_id"))
    return joins.teammates(held, leaders)


@query("j10_map_cars", """
SELECT driver_id AS car_number, lap_number, session_id, CASE WHEN driver_id % 13 = 0 THEN NULL ELSE driver_id * 10 END AS driver_id FROM laps
""")
def j10(spark, root):
    cars = v.laps(spark, root).select("session_id", F.col("driver_id").alias("car_number"), "lap_number")
    car_map = v.contracts(spark, root).select(
        F.col("driver_id").alias("car_number"), (F.col("driver_id") * 10).alias("driver_id")
    ).distinct()
    mapped, rejected = joins.map_cars(cars, car_map)
    return mapped.unionByName(rejected, allowMissingColumns=True)


@query("j11_nest_races", """
, nested AS (SELECT n_nationkey, n_name, n_regionkey, r_name, (SELECT COUNT(*) FROM nation) AS total FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r.r_regionkey AS id, r.r_name AS name, (SELECT MIN(circuit_name) FROM context c WHERE c.circuit_id = r.r_regionkey % 3) AS circuit, COUNT(n.n_nationkey) AS contracts,
  COALESCE(SUM(n.n_nationkey), 0)::BIGINT AS key_sum, COALESCE(string_agg(n.n_name, ',' ORDER BY n.n_nationkey), '') AS names
FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2
""")
def j11(spark, root):
    regions = v.read(spark, root, "region").select(
        F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), (F.col("r_regionkey") % 3).alias("circuit_id")
    )
    nations = v.read(spark, root, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("race_id"),
        F.col("n_name").alias("session_type"), F.lit(None).cast("date").alias("session_date"),
    )
    circuits = v.context(spark, root).select(F.col("circuit_id").alias("id"), "circuit_name").distinct()
    nested = joins.nest_races(regions, circuits, nations)
    return nested.select(
        "id", "name", F.col("circuit.circuit_name").alias("circuit"), F.size("sessions").cast("bigint").alias("contracts"),
        F.aggregate("sessions", F.lit(0).cast("bigint"), lambda a, s: a + s["id"]).alias("key_sum"),
        F.array_join(F.transform("sessions", lambda s: s["session_type"]), ",").alias("names"),
    )


@query("j11_nest_laps", """
SELECT session_id, driver_id, lap_number, CAST(3 AS BIGINT) AS parts, sector1_ms, sector3_ms FROM laps WHERE NOT (is_valid = FALSE)
UNION ALL SELECT session_id, driver_id, lap_number, 0, NULL, NULL FROM laps WHERE NOT is_valid
""")
def j11_laps(spark, root):
    key = F.concat_ws("-", *LAP)
    held = v.laps(spark, root).withColumn("id", key)
    parts = F.array(*[F.struct(F.lit(i + 1).alias("sector"), F.col(c).alias("time_ms")) for i, c in enumerate(SECTORS)])
    sectors = held.filter("is_valid").select(
        F.concat_ws("/", "id", F.lit("s")).alias("id"), F.col("id").alias("lap_data_id"), F.inline(parts)
    )
    nested = joins.nest_laps(held.select("id", *LAP), sectors)
    return nested.select(
        *LAP, F.size("sector_times").cast("bigint").alias("parts"),
        F.get("sector_times", F.lit(0))["time_ms"].alias("sector1_ms"),
        F.get("sector_times", F.lit(2))["time_ms"].alias("sector3_ms"),
    )


@query("j11_nest_drivers", """
SELECT d.driver_id AS id, COUNT(c.season) AS contracts, CAST(MIN(c.season) AS INT) AS first_season, MIN('Team ' || CAST(c.team_id AS VARCHAR)) AS team_name
FROM (SELECT DISTINCT driver_id FROM laps) d LEFT JOIN contracts c ON c.driver_id = d.driver_id GROUP BY 1
""")
def j11_drivers(spark, root):
    held = v.contracts(spark, root)
    teams = held.select(F.col("team_id").alias("id")).distinct().withColumn(
        "name", F.concat(F.lit("Team "), F.col("id").cast("string"))
    )
    drivers = v.laps(spark, root).select(F.col("driver_id").alias("id")).distinct()
    nested = joins.nest_drivers(
        drivers, held.withColumn("id", F.concat_ws("-", "driver_id", "season")), teams
    )
    first = F.get("contracts", F.lit(0))
    return nested.select(
        "id", F.size("contracts").cast("bigint").alias("contracts"), first["season"].alias("first_season"),
        first["team"]["name"].alias("team_name"),
    )


# Aggregates


@query("a01_elapsed_time", """
SELECT session_id, driver_id, CAST(COALESCE(SUM(CASE WHEN lap_number <= 10 THEN lap_ms END), 0) AS BIGINT) AS elapsed_ms FROM laps GROUP BY 1, 2
""")
def a01(spark, root):
    return agg.elapsed_time(v.laps(spark, root), 10, "lap_ms").withColumnRenamed("elapsed", "elapsed_ms")


@query("a02_laps_in_session", """
SELECT session_id, driver_id, lap_number, MAX(lap_number) OVER (PARTITION BY session_id) AS laps_in_session FROM laps
""")
def a02(spark, root):
    return agg.laps_in_session(v.laps(spark, root)).select(*LAP, "laps_in_session")


@query("a03_resolve_weather", """
, past AS (SELECT circuit_id, compound, AVG(track_temp) AS t, AVG(air_temp) AS a FROM laps l JOIN context c ON l.session_id = c.session_id WHERE track_temp IS NOT NULL GROUP BY 1, 2),
keys AS (SELECT DISTINCT l.session_id, circuit_id, compound FROM laps l JOIN context c ON l.session_id = c.session_id),
all_keys AS (SELECT * FROM keys UNION ALL SELECT DISTINCT session_id, circuit_id, 'UNKNOWN' FROM keys)
SELECT k.session_id, k.circuit_id, k.compound, CASE WHEN k.session_id = 1 THEN 41.5 ELSE ROUND(COALESCE(t, 35.0), 6) END AS track_temp,
  CASE WHEN k.session_id = 1 THEN 27.5 ELSE ROUND(COALESCE(a, 25.0), 6) END AS air_temp
FROM all_keys k LEFT JOIN past p ON p.circuit_id = k.circuit_id AND p.compound = k.compound
""")
def a03(spark, root):
    held = with_season(spark, root, v.laps(spark, root))
    keys = held.select("session_id", "circuit_id", "compound").distinct()
    keys = keys.unionByName(keys.select("session_id", "circuit_id", F.lit("UNKNOWN").alias("compound")).distinct())
    live = v.context(spark, root).filter("session_id = 1").select(
        "session_id", F.lit(41.5).alias("live_track"), F.lit(27.5).alias("live_air")
    )
    rows = agg.resolve_weather(keys, live, held)
    return rows.select("session_id", "circuit_id", "compound", F.round("track_temp", 6).alias("track_temp"),
                       F.round("air_temp", 6).alias("air_temp"))


@query("a04_lap_history", """
, recent AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, driver_id ORDER BY lap_number DESC) AS r FROM laps)
SELECT session_id, driver_id, strftime(date_trunc('minute', created_at), '%Y-%m-%d %H:%M:%S') AS bucket,
  ROUND(AVG(sector1_ms) / 1000.0, 6) AS avg_sector1, ROUND(AVG(sector2_ms) / 1000.0, 6) AS avg_sector2,
  ROUND(AVG(sector3_ms) / 1000.0, 6) AS avg_sector3, ROUND(AVG(lap_ms) / 1000.0, 6) AS avg_lap_time, COUNT(*) AS lap_count
FROM recent WHERE r <= 5 GROUP BY 1, 2, 3
""")
def a04(spark, root):
    rows = agg.lap_history(v.laps(spark, root), times=(*SECTORS, "lap_ms"))
    return rows.select(
        *DRIVER, day_text("bucket").alias("bucket"), secs("avg_sector1_ms").alias("avg_sector1"),
        secs("avg_sector2_ms").alias("avg_sector2"), secs("avg_sector3_ms").alias("avg_sector3"),
        secs("avg_lap_ms").alias("avg_lap_time"), "lap_count",
    )


@query("a05_build_stints", """
, l AS (SELECT *, CASE WHEN tyre_age_laps = 0 THEN NULL ELSE compound END AS seen FROM laps)
SELECT session_id, driver_id, stint_number, FIRST(seen ORDER BY lap_number) FILTER (WHERE seen IS NOT NULL) AS compound, MIN(lap_number) AS start_lap, MAX(lap_number) AS end_lap
FROM l GROUP BY 1, 2, 3 HAVING COUNT(seen) > 0
""")
def a05(spark, root):
    late = v.laps(spark, root).withColumn("compound", F.when(F.col("tyre_age_laps") > 0, F.col("compound")))
    return agg.build_stints(late)


SLOPES_SQL = """
, slopes AS (SELECT l.session_id, l.driver_id, s.stint_number, REGR_SLOPE(l.lap_ms / 1000.0, l.lap_number) AS slope FROM laps l JOIN stints s
ON l.session_id = s.session_id AND l.driver_id = s.driver_id AND l.lap_number BETWEEN s.start_lap AND COALESCE(s.end_lap, s.start_lap)
WHERE l.is_valid AND l.lap_ms IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) >= 2)
"""


def slopes(spark, root) -> DataFrame:
    held = v.laps(spark, root).withColumn("lap_s", F.col("lap_ms") / 1000.0)
    return agg.stint_slopes(held, v.stints(spark, root), "lap_s")


@query("a06_stint_slopes", SLOPES_SQL + """
SELECT session_id, driver_id, stint_number, ROUND(slope, 6) AS avg_deg_per_lap FROM slopes
""")
def a06(spark, root):
    return slopes(spark, root).withColumn("avg_deg_per_lap", F.round("avg_deg_per_lap", 6))


STYLE_SQL = SLOPES_SQL + """
, ls AS (SELECT l.*, season FROM laps l JOIN context c ON l.session_id = c.session_id),
dev AS (SELECT driver_id, season, STDDEV_SAMP(sector1_ms / 1000.0) AS d1, STDDEV_SAMP(sector2_ms / 1000.0) AS d2, STDDEV_SAMP(sector3_ms / 1000.0) AS d3 FROM ls GROUP BY 1, 2),
sector_var AS (SELECT driver_id, season, (COALESCE(d1, 0) + COALESCE(d2, 0) + COALESCE(d3, 0)) / NULLIF((d1 IS NOT NULL)::INT + (d2 IS NOT NULL)::INT + (d3 IS NOT NULL)::INT, 0) AS sector_time_variance FROM dev),
consistency AS (SELECT driver_id, season, STDDEV_SAMP(lap_ms / 1000.0) AS lap_time_consistency FROM ls WHERE is_valid GROUP BY 1, 2),
lens AS (SELECT driver_id, season, AVG(COALESCE(end_lap, m) - start_lap + 1) AS stint_length_tendency
  FROM stints s JOIN context c ON s.session_id = c.session_id JOIN (SELECT session_id, MAX(lap_number) AS m FROM laps GROUP BY 1) x ON x.session_id = s.session_id GROUP BY 1, 2),
graded AS (SELECT s.driver_id, season, s.compound, slope FROM slopes d JOIN stints s ON s.session_id = d.session_id AND s.driver_id = d.driver_id AND s.stint_number = d.stint_number JOIN context c ON c.session_id = s.session_id),
z AS (SELECT driver_id, season, (slope - AVG(slope) OVER w) / NULLIF(STDDEV_SAMP(slope) OVER w, 0) AS z FROM graded WINDOW w AS (PARTITION BY season, compound)),
tyres AS (SELECT driver_id, season, AVG(z) AS tyre_management_index FROM z GROUP BY 1, 2)
"""


def season_laps(spark, root) -> DataFrame:
    held = with_season(spark, root, v.laps(spark, root))
    return held.select(
        *LAP, "season", "compound", "is_valid", "tyre_age_laps",
        *[(F.col(c) / 1000.0).alias(c.replace("_ms", "_seconds")) for c in SECTORS],
        (F.col("lap_ms") / 1000.0).alias("lap_time_seconds"),
    )


def season_stints(spark, root) -> DataFrame:
    held = v.stints(spark, root).join(slopes(spark, root), [*DRIVER, "stint_number"], "left")
    return with_season(spark, root, held).select(
        *DRIVER, "season", "stint_number", "compound", "start_lap", "end_lap", "avg_deg_per_lap"
    )


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("a07_sector_time_variance", STYLE_SQL + "SELECT driver_id, season, ROUND(sector_time_variance, 6) AS sector_time_variance FROM sector_var")
def a07(spark, root):
    return rounded(agg.sector_time_variance(season_laps(spark, root)), "sector_time_variance")


@query("a08_lap_time_consistency", STYLE_SQL + "SELECT driver_id, season, ROUND(lap_time_consistency, 6) AS lap_time_consistency FROM consistency")
def a08(spark, root):
    return rounded(agg.lap_time_consistency(season_laps(spark, root)), "lap_time_consistency")


@query("a09_stint_length_tendency", STYLE_SQL + "SELECT driver_id, season, ROUND(stint_length_tendency, 6) AS stint_length_tendency FROM lens")
def a09(spark, root):
    stints = with_season(spark, root, v.stints(spark, root))
    return rounded(agg.stint_length_tendency(stints, v.laps(spark, root)), "stint_length_tendency")


@query("a10_tyre_management_index", STYLE_SQL + "SELECT driver_id, season, ROUND(tyre_management_index, 6) AS tyre_management_index FROM tyres")
def a10(spark, root):
    return rounded(agg.tyre_management_index(season_stints(spark, root)), "tyre_management_index")


@query("j12_style_features", STYLE_SQL + """
SELECT driver_id, season, ROUND(sector_time_variance, 6) AS sector_time_variance, ROUND(tyre_management_index, 6) AS tyre_management_index,
  ROUND(lap_time_consistency, 6) AS lap_time_consistency, ROUND(stint_length_tendency, 6) AS stint_length_tendency
FROM sector_var JOIN tyres USING (driver_id, season) JOIN consistency USING (driver_id, season) JOIN lens USING (driver_id, season)
WHERE sector_time_variance IS NOT NULL AND tyre_management_index IS NOT NULL AND lap_time_consistency IS NOT NULL AND stint_length_tendency IS NOT NULL
""")
def j12(spark, root):
    from paddock.fixed import STYLE_FEATURES

    return rounded(agg.style_features(season_laps(spark, root), season_stints(spark, root)), *STYLE_FEATURES)


@query("a11_performance_vs_team", """
, m AS (SELECT l.session_id, season, driver_id, AVG(CASE WHEN is_valid THEN lap_ms END) / 1000.0 AS driver_mean FROM laps l JOIN context c ON l.session_id = c.session_id GROUP BY 1, 2, 3),
r AS (SELECT m.*, team_id FROM m LEFT JOIN contracts c ON c.driver_id = m.driver_id AND c.season = m.season),
t AS (SELECT session_id, team_id, AVG(driver_mean) AS team_mean FROM r WHERE team_id IS NOT NULL GROUP BY 1, 2)
SELECT r.session_id, r.driver_id, r.team_id, ROUND(driver_mean - team_mean, 6) AS performance_vs_team FROM r LEFT JOIN t ON t.session_id = r.session_id AND t.team_id = r.team_id
""")
def a11(spark, root):
    return rounded(agg.performance_vs_team(season_laps(spark, root), v.contracts(spark, root)), "performance_vs_team")


RATES_SQL = FLAGS_SQL + """
, base AS (SELECT f.*, circuit_name FROM flags f JOIN context c ON f.session_id = c.session_id WHERE lap_number <> 1 AND NOT wet_track),
rates AS (SELECT circuit_name, SUM(is_sc_event::INT) / COUNT(*) AS rate FROM base GROUP BY 1 HAVING COUNT(*) >= 200
  UNION ALL SELECT NULL, COALESCE(SUM(is_sc_event::INT) / NULLIF(COUNT(*), 0), 0) FROM base)
"""


def circuit_flags(spark, root) -> DataFrame:
    return with_season(spark, root, windows.lap_flags(v.laps(spark, root)))


@query("a12_fit_sc_rates", RATES_SQL + "SELECT circuit_name, ROUND(rate, 9) AS rate FROM rates")
def a12(spark, root):
    return agg.fit_sc_rates(circuit_flags(spark, root)).withColumn("rate", F.round("rate", 9))


@query("a13_roster", "SELECT DISTINCT session_id, driver_id FROM laps")
def a13(spark, root):
    return agg.roster(v.laps(spark, root))


@query("a14_regression_metrics", """
, p AS (SELECT session_id AS fold, lap_ms / 1000.0 AS label, (sector2_ms + sector3_ms) / 1000.0 AS prediction FROM laps WHERE lap_ms IS NOT NULL),
f AS (SELECT fold, AVG(ABS(prediction - label)) AS mae, SQRT(AVG((prediction - label) * (prediction - label))) AS rmse, COUNT(*) AS n FROM p GROUP BY 1)
SELECT fold, ROUND(mae, 6) AS mae, ROUND(rmse, 6) AS rmse, n FROM f
UNION ALL SELECT NULL, ROUND(AVG(mae), 6), ROUND(AVG(rmse), 6), CAST(SUM(n) AS BIGINT) FROM f
""")
def a14(spark, root):
    pred = v.laps(spark, root).filter("lap_ms is not null").select(
        F.col("session_id").alias("fold"), (F.col("lap_ms") / 1000.0).alias("label"),
        ((F.col("sector2_ms") + F.col("sector3_ms")) / 1000.0).alias("prediction"),
    )
    return rounded(agg.regression_metrics(pred), "mae", "rmse")


@query("a15_auc", PIT_SQL + """
, p AS (SELECT session_id AS fold, did_pit_this_lap AS y, lap_number % 7 + tyre_age_laps / 10.0 AS s FROM labelled),
r AS (SELECT fold, y, RANK() OVER (PARTITION BY fold ORDER BY s) + (COUNT(*) OVER (PARTITION BY fold, s) - 1) / 2.0 AS rk FROM p),
c AS (SELECT fold, SUM(CASE WHEN y THEN rk ELSE 0 END) AS ranks, SUM(y::INT) AS pos, SUM((NOT y)::INT) AS neg FROM r GROUP BY 1)
SELECT fold, ROUND((ranks - pos * (pos + 1) / 2.0) / (pos * neg), 6) AS auc FROM c WHERE pos > 0 AND neg > 0
""")
def a15(spark, root):
    rows = joins.label_pit_laps(v.laps(spark, root), v.stints(spark, root)).select(
        F.col("session_id").alias("fold"), F.col("did_pit_this_lap").alias("label"),
        (F.col("lap_number") % 7 + F.col("tyre_age_laps") / 10.0).alias("score"),
    )
    return rounded(agg.auc(rows), "auc")


def samples(spark, root) -> DataFrame:
    """Every lap number is a run, in every session, and its lap times are finish times."""
    return v.laps(spark, root).filter("lap_ms is not null").select(
        "session_id", F.col("lap_number").alias("sim"), "driver_id", F.col("lap_ms").alias("finish_time")
    )


SAMPLES_SQL = """
, samples AS (SELECT session_id, lap_number AS sim, driver_id, lap_ms AS finish_time FROM laps WHERE lap_ms IS NOT NULL),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, sim ORDER BY finish_time, driver_id) AS position FROM samples),
dist AS (SELECT session_id, driver_id, AVG(position) AS mean_position, AVG(finish_time) AS mean_finish_time, QUANTILE_CONT(finish_time, 0.05) AS finish_time_p5,
  QUANTILE_CONT(finish_time, 0.95) AS finish_time_p95 FROM placed GROUP BY 1, 2)
"""


@query("a16_finish_distribution", SAMPLES_SQL + """
SELECT session_id, driver_id, ROUND(mean_position, 6) AS mean_position, ROUND(mean_finish_time, 6) AS mean_finish_time,
  ROUND(finish_time_p5, 6) AS finish_time_p5, ROUND(finish_time_p95, 6) AS finish_time_p95 FROM dist
""")
def a16(spark, root):
    dist = agg.finish_distribution(samples(spark, root))
    return rounded(dist, "mean_position", "mean_finish_time", "finish_time_p5", "finish_time_p95")


@query("a16_finish_positions", SAMPLES_SQL + """
, n AS (SELECT session_id, driver_id, position, COUNT(*) AS n FROM placed GROUP BY 1, 2, 3),
every AS (SELECT session_id, driver_id, UNNEST(range(1, last + 1)) AS position, total
  FROM (SELECT session_id, driver_id, COUNT(*) AS total FROM placed GROUP BY 1, 2) JOIN (SELECT session_id, MAX(position) AS last FROM placed GROUP BY 1) USING (session_id))
SELECT e.session_id, e.driver_id, e.position, ROUND(COALESCE(n, 0) / total, 6) AS probability FROM every e LEFT JOIN n USING (session_id, driver_id, position)
""")
def a16_positions(spark, root):
    return rounded(agg.finish_positions(samples(spark, root)), "probability")


@query("a17_position_gain", SAMPLES_SQL + """
SELECT session_id, driver_id, CAST(ROUND_EVEN(1 + (driver_id + session_id) % 20 - mean_position, 0) AS INT) AS position_gain FROM dist
""")
def a17(spark, root):
    dist = agg.finish_distribution(samples(spark, root))
    start = 1 + (F.col("driver_id") + F.col("session_id")) % 20
    grid = v.laps(spark, root).select("session_id", "driver_id").distinct().withColumn("start_position", start)
    return agg.position_gain(dist, grid)


@query("a18_hit_rates", """
SELECT 'live:*:*:gaps' AS key_pattern, ROUND(AVG(cache_hit::INT), 6) AS hit_rate, COUNT(*) AS requests FROM request_log
""")
def a18(spark, root):
    return rounded(agg.hit_rates(v.request_log(spark, root)), "hit_rate")


@query("a18_error_ratio", "SELECT ROUND(SUM((status >= 500)::INT) / COUNT(*), 6) AS error_ratio FROM request_log")
def a18_errors(spark, root):
    return rounded(agg.error_ratio(v.request_log(spark, root)), "error_ratio")


# Reshaping, codes, sets


@query("t01_page", """
SELECT session_id, driver_id, lap_number, (SELECT COUNT(*) FROM laps) AS total FROM laps ORDER BY session_id DESC, driver_id, lap_number LIMIT 20 OFFSET 40
""")
def t01(spark, root):
    rows, total = reshape.page(
        v.laps(spark, root).select(*LAP), [F.desc("session_id"), F.asc("driver_id"), F.asc("lap_number")], 3, 20
    )
    return rows.withColumn("total", F.lit(total).cast("bigint"))


@query("t01_all_pages", """
, r AS (SELECT session_id, driver_id, lap_number, ROW_NUMBER() OVER (ORDER BY session_id, driver_id, lap_number) AS "row" FROM laps)
SELECT *, CAST(FLOOR(("row" - 1) / 20) + 1 AS BIGINT) AS page FROM r
""")
def t01_all(spark, root):
    return reshape.paged(v.laps(spark, root).select(*LAP), LAP)


@query("t02_top_k", """
SELECT session_id, driver_id, lap_number, lap_ms FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY lap_ms, driver_id, lap_number) AS r FROM laps WHERE lap_ms IS NOT NULL) WHERE r <= 3
""")
def t02(spark, root):
    timed = v.laps(spark, root).filter("lap_ms is not null").select(*LAP, "lap_ms")
    return reshape.top_k(timed, ["session_id"], [F.col(c) for c in ("lap_ms", "driver_id", "lap_number")], 3)


@query("t03_current_event", """
, plan AS (SELECT year(o_orderdate) AS season, o_orderkey AS round_number, CAST(o_orderdate AS DATE) AS race_date FROM orders),
target AS (SELECT season, COALESCE(MIN(round_number) FILTER (WHERE race_date >= DATE '1995-12-20'), MAX(round_number)) AS round_number FROM plan GROUP BY 1)
SELECT CAST(season AS INT) AS season, round_number, strftime(race_date, '%Y-%m-%d') AS race_date FROM plan JOIN target USING (season, round_number)
""")
def t03(spark, root):
    """Every order is a round of its year, in key order."""
    plan = v.read(spark, root, "orders").select(
        F.year("o_orderdate").alias("season"), F.col("o_orderkey").alias("round_number"), F.col("o_orderdate").cast("date").alias("race_date")
    )
    rows = reshape.current_event(plan, plan, date(1995, 12, 20))
    return rows.select("season", "round_number", F.date_format("race_date", "yyyy-MM-dd").alias("race_date"))


@query("t06_alert_feed", """
SELECT user_id, session_id, lap_number AS id, triggered_at FROM (SELECT driver_id AS user_id, session_id, lap_number, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS triggered_at, is_valid FROM laps) WHERE is_valid
""")
def t06(spark, root):
    alerts = v.laps(spark, root).select(
        F.col("driver_id").alias("user_id"), "session_id", F.col("lap_number").alias("id"),
        day_text("created_at").alias("triggered_at"),
        F.when(~F.col("is_valid"), F.col("created_at")).alias("read_at"),
    )
    return reshape.alert_feed(alerts, unread=True).select("user_id", "session_id", "id", "triggered_at")


@query("p09_categorical_codes", """
, l AS (SELECT session_id, driver_id, lap_number, CASE WHEN lap_number % 9 = 0 THEN NULL ELSE compound END AS compound FROM laps),
c AS (SELECT compound, ROW_NUMBER() OVER (ORDER BY compound) - 1 AS code FROM (SELECT DISTINCT compound FROM l WHERE compound IS NOT NULL)),
d AS (SELECT driver_id, ROW_NUMBER() OVER (ORDER BY driver_id) - 1 AS code FROM (SELECT DISTINCT driver_id FROM l))
SELECT l.session_id, l.driver_id, lap_number, CAST(COALESCE(c.code, -1) AS INT) AS compound_encoded, CAST(d.code AS INT) AS driver_id_encoded
FROM l LEFT JOIN c ON c.compound = l.compound LEFT JOIN d ON d.driver_id = l.driver_id
""")
def p09(spark, root):
    rows = v.laps(spark, root).select(*LAP, F.when(F.col("lap_number") % 9 != 0, F.col("compound")).alias("compound"))
    return encode.categorical_codes(rows, ["compound", "driver_id"]).drop("compound")


@query("h03_group_folds", """
, s AS (SELECT driver_id, CAST((ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, driver_id) - 1) % 5 AS INT) AS fold FROM laps GROUP BY driver_id)
SELECT l.session_id, l.driver_id, l.lap_number, fold FROM laps l JOIN s ON s.driver_id = l.driver_id
""")
def h03(spark, root):
    return encode.group_folds(v.laps(spark, root).select(*LAP), "driver_id", 5)


@query("x01_missing_keys", """
SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
""")
def x01(spark, root):
    lines = v.read(spark, root, "lineitem").select("l_orderkey", "l_linenumber")
    held = v.read(spark, root, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    known = lines.join(held, "l_orderkey", "left_semi")
    return encode.missing_keys(lines, known, ["l_orderkey", "l_linenumber"])
