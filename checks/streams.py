"""Live path: batch functions and the streams built on them.

Stream checks feed the tables in two parts and restart the query from its checkpoint in
between; the stored result must equal the batch SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import query
from checks.models import SCORED_SQL, _flat_sc
from checks.relational import DRIVER, LAP, PREDICTIONS_SQL, SUBSCRIPTIONS_SQL, predictions, rounded, subscriptions
from checks.strategy import pit_score, state, tyre_score
from checks.values import CHANNEL_SQL, deflate_text, entries, lap_records
from paddock.ml import scoring
from paddock.operators import ordered
from paddock.scratch import new_path
from paddock.sources import feed
from paddock.sources import lapview as v
from paddock.streaming import alerts, live, rules

NOW = datetime(2024, 1, 31)


def in_parts(spark, parts: list[DataFrame], run: Callable[[DataFrame], object]) -> None:
    """Append each part to a folder and run the stream over what is new."""
    folder = new_path(spark, "feed")
    schema = parts[0].schema
    for part in parts:
        part.write.mode("append").parquet(folder)
        run(spark.readStream.schema(schema).parquet(folder)).awaitTermination()


def text(c: str):
    return F.col(c).cast("string")


def feed_rows(spark, root) -> DataFrame:
    """Feed messages from laps: topics in turn, every thirteenth message broken, every ninth of a wrong shape."""
    lap = F.col("lap_number")
    cars = F.format_string('{"Cars": {"%s": %s}}', text("driver_id"), F.col("entry"))
    timing = F.format_string(
        '{"Lines": {"%s": {"NumberOfLaps": %s, "LastLapTime": {"Value": "%s"}}}}',
        text("driver_id"), text("lap_number"), (F.col("sector2_ms") / 1000.0).cast("string"),
    )
    weather = F.format_string('{"TrackTemp": "%s", "AirTemp": "%s"}', text("track_temp"), text("air_temp"))
    kind = lap % 4
    odd = F.when(kind == 1, F.when(lap % 2 == 1, '{"Lines": 5}').otherwise("[1]")).otherwise(F.lit("7"))
    payload = F.when(lap % 9 == 0, odd).when(kind == 1, timing).when(kind == 2, weather).otherwise("{}")
    topic = F.when(kind == 1, "TimingData").when(kind == 2, "WeatherData").otherwise("SessionInfo")

    def messages(rows, topic, payload) -> DataFrame:
        return rows.select(*LAP, topic.alias("topic"), F.when(lap % 13 == 0, "{broken").otherwise(payload).alias("payload"))

    rows = entries(spark, root)
    return messages(rows.filter(kind == 0), F.lit("CarData.z"), deflate_text(cars)).unionByName(messages(rows.filter(kind != 0), topic, payload))


@query("r01_split_topics", """
, m AS (SELECT session_id, driver_id, lap_number, lap_number % 4 AS kind, lap_number % 13 = 0 OR (lap_number % 9 = 0 AND lap_number % 4 > 0) AS broken FROM laps WHERE lap_number % 4 <> 3)
SELECT session_id, driver_id, lap_number, CASE WHEN broken THEN 'rejects' ELSE ['cars', 'timing', 'weather'][kind + 1] END AS part, CASE WHEN NOT broken AND kind < 2 THEN CAST(driver_id AS VARCHAR) END AS car_number FROM m
""")
def r01(spark, root):
    parts = live.split_topics(feed_rows(spark, root))
    out = None
    for name, df in parts.items():
        car = F.col("car_number") if "car_number" in df.columns else F.lit(None).cast("string")
        rows = df.select(*LAP, F.lit(name).alias("part"), car.alias("car_number"))
        out = rows if out is None else out.unionByName(rows)
    return out


def timing_rows(spark, root) -> DataFrame:
    """Timing messages in lap order; some report an old lap, some none."""
    lap = F.col("lap_number")
    number = F.when(lap % 11 != 0, F.when(lap % 4 == 0, lap - 2).otherwise(lap))

    def clock(c):
        return F.struct(F.concat(F.floor(c / 60000).cast("string"), F.lit(":"), F.format_string("%06.3f", (c % 60000) / 1000.0)).alias("Value"))

    sectors = F.create_map(F.lit("0"), clock(F.col("sector1_ms")), F.lit("1"), clock(F.col("sector2_ms")), F.lit("2"), clock(F.col("sector3_ms")))
    entry = F.struct(number.cast("int").alias("NumberOfLaps"), clock(F.col("lap_ms")).alias("LastLapTime"), sectors.alias("Sectors"))
    return v.laps(spark, root).select(text("session_id").alias("session_id"), text("driver_id").alias("car_number"), F.col("lap_number").alias("seq"), entry.alias("entry"))


COMPLETED_SQL = """
, t AS (SELECT *, CASE WHEN lap_number % 11 <> 0 THEN CASE WHEN lap_number % 4 = 0 THEN lap_number - 2 ELSE lap_number END END AS n FROM laps),
b AS (SELECT *, MAX(n) OVER (PARTITION BY session_id, driver_id ORDER BY lap_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM t)
SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(driver_id AS VARCHAR) AS car_number, lap_number AS seq, CAST(n AS INT) AS lap_number, ROUND(lap_ms / 1000.0, 6) AS lap_time_seconds, ROUND(sector1_ms / 1000.0, 6) AS sector1_seconds, 'UNKNOWN' AS compound
FROM b WHERE n > COALESCE(best, 0)
"""
COMPLETED = ("session_id", "car_number", "seq", "lap_number", "lap_time_seconds", "sector1_seconds", "compound")


@query("r02_completed_laps", COMPLETED_SQL)
def r02(spark, root):
    laps, _ = live.completed_laps(timing_rows(spark, root))
    return rounded(laps.select(*COMPLETED), "lap_time_seconds", "sector1_seconds")


@query("r02_completed_laps_stream", COMPLETED_SQL)
def r02_stream(spark, root):
    rows, path = timing_rows(spark, root), new_path(spark, "r02")
    in_parts(spark, [rows.filter("seq <= 8"), rows.filter("seq > 8")], lambda s: live.lap_completions(s, path))
    laps = live.read_batches(spark, f"{path}/laps").withColumn("session_id", text("session_id"))
    return rounded(laps.select(*COMPLETED), "lap_time_seconds", "sector1_seconds")


@query("r02_live_chain", COMPLETED_SQL.replace("FROM b WHERE", "FROM b WHERE driver_id % 13 <> 0 AND").replace("CAST(driver_id AS VARCHAR) AS car_number", "CAST(driver_id AS VARCHAR) AS driver_id"))
def r02_chain(spark, root):
    """Timing rows to completed laps of mapped cars to the stored lap table, one stream after the other."""
    rows = timing_rows(spark, root).withColumn("ts", F.timestamp_seconds(F.col("seq") * 90))
    path, cars = new_path(spark, "chain"), _car_map(spark, root)
    in_parts(spark, [rows.filter("seq <= 8"), rows.filter("seq > 8")], lambda s: live.lap_completions(s, path, cars))
    done = live.read_batches(spark, f"{path}/laps").withColumn("session_id", text("session_id"))
    in_parts(spark, [done.drop("batch_id", "entry")], lambda s: live.upsert_laps(s, f"{path}/stored", f"{path}/upsert"))
    stored = spark.read.parquet(f"{path}/stored").withColumn("session_id", text("session_id"))
    return rounded(stored.select(*[c if c != "car_number" else "driver_id" for c in COMPLETED]), "lap_time_seconds", "sector1_seconds")


def car_rows(spark, root) -> DataFrame:
    from paddock.schemas import CAR_ENTRY

    return entries(spark, root).select(
        text("session_id").alias("session_id"), text("driver_id").alias("car_number"),
        F.col("created_at").cast("timestamp").alias("ts"), F.from_json("entry", CAR_ENTRY).alias("entry"), "lap_number",
    )


LATEST_SQL = f"""
, c AS (SELECT session_id, driver_id, lap_number, created_at, {CHANNEL_SQL} FROM laps),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, driver_id ORDER BY created_at DESC, speed_kmh DESC NULLS LAST, throttle_pct DESC NULLS LAST, brake DESC NULLS LAST, gear DESC NULLS LAST) AS r FROM c)
SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(driver_id AS VARCHAR) AS car_number, speed_kmh, throttle_pct, brake, gear, drs, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS ts FROM r WHERE r = 1
"""


def _shown(latest: DataFrame) -> DataFrame:
    return rounded(latest.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "speed_kmh")


@query("r03_latest_car", LATEST_SQL)
def r03(spark, root):
    return _shown(live.latest_car(car_rows(spark, root)))


@query("r03_latest_car_stream", LATEST_SQL)
def r03_stream(spark, root):
    rows, path = car_rows(spark, root), new_path(spark, "r03")
    parts = [rows.filter("lap_number <= 5"), rows.filter("lap_number between 6 and 8"), rows.filter("lap_number > 8")]
    in_parts(spark, parts, lambda s: live.store_latest(s, live.latest_car, path, every=1))
    return _shown(live.read_latest(spark, path, ("session_id", "car_number"), live.CHANNEL_FIELDS))


@query("r03_fresh_cars", f"""
, c AS (SELECT session_id, driver_id, MAX(created_at) AS ts FROM laps GROUP BY 1, 2)
SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(driver_id AS VARCHAR) AS car_number FROM c WHERE epoch_ms(TIMESTAMP '2024-01-30 12:00:00') - epoch_ms(ts) BETWEEN 0 AND 43199999
""")
def r03_fresh(spark, root):
    """Cars whose newest sample is less than twelve hours old."""
    latest = live.latest_car(car_rows(spark, root))
    return live.fresh(latest, datetime(2024, 1, 30, 12), 43_200).select("session_id", "car_number")


WEATHER_SQL = """
, w AS (SELECT session_id, created_at, track_temp + 0.5 AS track_temp, air_temp + 0.5 AS air_temp FROM laps WHERE track_temp IS NOT NULL AND air_temp IS NOT NULL AND lap_number % 3 <> 0),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY created_at DESC, track_temp DESC, air_temp DESC) AS r FROM w)
SELECT session_id, CAST(track_temp AS DOUBLE) AS track_temp, CAST(air_temp AS DOUBLE) AS air_temp, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS ts FROM r WHERE r = 1
"""


def weather_rows(spark, root) -> DataFrame:
    return v.laps(spark, root).select(
        "session_id", F.col("created_at").cast("timestamp").alias("ts"), "lap_number",
        F.when(F.col("lap_number") % 3 == 0, "dry").otherwise((F.col("track_temp") + 0.5).cast("string")).alias("TrackTemp"),
        (F.col("air_temp") + 0.5).cast("string").alias("AirTemp"),
    )


@query("r04_latest_weather", WEATHER_SQL)
def r04(spark, root):
    return live.latest_weather(weather_rows(spark, root)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("r04_latest_weather_stream", WEATHER_SQL)
def r04_stream(spark, root):
    rows, path = weather_rows(spark, root), new_path(spark, "r04")
    in_parts(spark, [rows.filter("lap_number > 8"), rows.filter("lap_number <= 8")], lambda s: live.store_latest(s, live.latest_weather, path, ("session_id",), every=1))
    latest = live.read_latest(spark, path, ("session_id",), ("track_temp", "air_temp"))
    return latest.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


UPSERT_SQL = """
SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(driver_id AS VARCHAR) AS driver_id, lap_number, ROUND(lap_ms / 1000.0, 6) AS lap_time_seconds FROM laps
"""


@query("r05_upsert_laps_stream", UPSERT_SQL)
def r05_stream(spark, root):
    """Newer laps come first; laps days older, duplicates and repeats follow after the restart."""
    rows, path = lap_records(spark, root), new_path(spark, "r05")
    old = (F.col("created_at") < "2024-01-15") | (F.col("lap_number") % 5 == 0)
    first, late = rows.filter(~old), rows.filter(old)
    again = first.filter("lap_number % 3 = 0")
    in_parts(
        spark, [first.unionByName(first), late.unionByName(late).unionByName(again)],
        lambda s: live.upsert_laps(s, f"{path}/laps", f"{path}/checkpoint"),
    )
    return spark.read.schema(rows.schema).parquet(f"{path}/laps").select("session_id", "driver_id", "lap_number", "lap_time_seconds")


ENRICH_SQL = f"""
, c AS (SELECT session_id, driver_id, lap_number, created_at, {CHANNEL_SQL} FROM laps),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, driver_id ORDER BY created_at DESC, speed_kmh DESC NULLS LAST, throttle_pct DESC NULLS LAST, brake DESC NULLS LAST, gear DESC NULLS LAST) AS r FROM c),
newest AS (SELECT * FROM r WHERE r = 1 AND driver_id % 13 <> 0 AND epoch_ms(TIMESTAMP '2024-01-30 18:00:00') - epoch_ms(created_at) BETWEEN 0 AND 7999)
SELECT CAST(l.session_id AS VARCHAR) AS session_id, 'lap_completed' AS event, CAST(l.driver_id AS VARCHAR) AS driver_id, l.lap_number, n.speed_kmh, n.drs FROM laps l LEFT JOIN newest n ON n.session_id = l.session_id AND n.driver_id = l.driver_id
"""


def _car_map(spark, root) -> DataFrame:
    return v.contracts(spark, root).select(text("driver_id").alias("driver_id"), text("driver_id").alias("car_number")).distinct()


def _enriched(rows: DataFrame) -> DataFrame:
    return rounded(rows.select("session_id", "event", "data.driver_id", "data.lap_number", "data.speed_kmh", "data.drs"), "speed_kmh")


@query("r06_enrich_laps", ENRICH_SQL)
def r06(spark, root):
    return _enriched(live.enrich_laps(lap_records(spark, root), live.latest_car(car_rows(spark, root)), _car_map(spark, root), datetime(2024, 1, 30, 18)))


@query("r06_enrich_laps_stream", ENRICH_SQL)
def r06_stream(spark, root):
    rows, path, channels = lap_records(spark, root), new_path(spark, "r06"), live.latest_car(car_rows(spark, root))
    in_parts(
        spark, [rows.filter("lap_number > 8"), rows.filter("lap_number <= 8")],
        lambda s: live.enrich_stream(s, lambda: channels, _car_map(spark, root), path, lambda: datetime(2024, 1, 30, 18)),
    )
    return _enriched(live.read_batches(spark, f"{path}/events"))


R07_FIELDS = ("optimal_pit_lap", "pit_probability", "tire_life_remaining", "confidence_score")


@query("r07_predict_stream", SCORED_SQL + f"SELECT session_id, driver_id, lap_number, {', '.join(f'{c}, {c} AS sent_{c}' for c in R07_FIELDS)} FROM predicted")
def r07(spark, root):
    """Latest laps streamed in two parts through the scorer to the prediction sink; stored values and message fields."""
    held = v.laps(spark, root).withColumn("lap_time_seconds", F.col("lap_ms") / 1000.0)
    now = state(spark, root).withColumn("circuit_name", F.lit("Test"))
    rates = v.context(spark, root).agg(F.lit(None).cast("string").alias("circuit_name"), F.lit(0.01).alias("rate"))
    score = scoring.lap_scorer(lambda: held, lambda _: now, rates, tyre_score, _flat_sc(pit_score))
    batch, path = now.select(*LAP, "compound", "tyre_age_laps"), new_path(spark, "r07")
    in_parts(spark, [batch.filter("driver_id % 2 = 0"), batch.filter("driver_id % 2 = 1")], lambda s: alerts.predict_stream(s, score, path))
    rows = live.read_batches(spark, f"{path}/strategy_predictions")
    fields = "session_id int, driver_id bigint, optimal_pit_lap int, pit_probability double, tire_life_remaining double, confidence_score double"
    sent = live.read_batches(spark, f"{path}/messages").select(F.from_json("value", fields).alias("m")).select("m.*")
    both = rows.select(*LAP, *R07_FIELDS).join(sent.select(*DRIVER, *[F.col(c).alias(f"sent_{c}") for c in R07_FIELDS]), DRIVER, "left")
    return both.withColumns({c: F.round(c, 8) for c in both.columns if c.endswith(("pit_probability", "tire_life_remaining"))})


def messages(spark, root) -> DataFrame:
    """Stored predictions as JSON, one in fifty cut short."""
    whole = F.to_json(F.struct(text("session_id").alias("session_id"), text("driver_id").alias("driver_id"), F.col("pit_probability").cast("double").alias("pit_probability")))
    broken = F.col("id") % 50 == 49
    return predictions(spark, root).select("id", F.when(broken, F.substring(whole, 1, 20)).otherwise(whole).alias("value"))


def users(spark, root) -> DataFrame:
    return v.read(spark, root, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("t"), text("c_custkey"))).alias("fcm_token")
    )


def followers(spark, root) -> DataFrame:
    return subscriptions(spark, root).withColumn("driver_ids", F.transform("driver_ids", lambda d: d.cast("string")))


PIT_ALERT_SQL = PREDICTIONS_SQL + SUBSCRIPTIONS_SQL + """
SELECT user_id, CAST(session_id AS VARCHAR) AS session_id, 'PIT_WINDOW_OPEN' AS alert_type, CAST(p.driver_id AS VARCHAR) AS driver_id,
  'Driver ' || p.driver_id || ': pit probability ' || ((id * 17 + p.driver_id * 7) % 100) || '%' AS message, user_id % 5 <> 0 AS deliverable
FROM predictions p JOIN subs s ON s.driver_id = p.driver_id WHERE pit_probability >= 0.5 AND id % 50 <> 49
"""


@query("r08_pit_alerts", PIT_ALERT_SQL)
def r08(spark, root):
    return alerts.pit_alerts(messages(spark, root), followers(spark, root), users(spark, root))


@query("r08_pit_alert_stream", PREDICTIONS_SQL + SUBSCRIPTIONS_SQL + """
SELECT user_id, CAST(session_id AS VARCHAR) AS session_id, CAST(p.driver_id AS VARCHAR) AS driver_id, '2024-01-31' AS triggered_on, TRUE AS unread
FROM predictions p JOIN subs s ON s.driver_id = p.driver_id WHERE pit_probability >= 0.5 AND id % 50 <> 49
""")
def r08_stream(spark, root):
    rows, path = messages(spark, root), new_path(spark, "r08")
    subs, people = followers(spark, root), users(spark, root)
    in_parts(
        spark, [rows.filter("id <= 8"), rows.filter("id > 8")],
        lambda s: alerts.pit_alert_stream(s, subs, people, path, lambda: NOW),
    )
    stored = live.read_batches(spark, f"{path}/alerts")
    return stored.select(
        "user_id", "session_id", "driver_id", F.date_format("triggered_at", "yyyy-MM-dd").alias("triggered_on"),
        F.col("read_at").isNull().alias("unread"),
    )


@query("r09_undercut_threats", PREDICTIONS_SQL + SUBSCRIPTIONS_SQL + """
, last AS (SELECT * FROM (SELECT session_id, driver_id, position, ROW_NUMBER() OVER (PARTITION BY session_id, driver_id ORDER BY lap_number DESC) AS r FROM laps) WHERE r = 1 AND position IS NOT NULL),
pr AS (SELECT session_id, driver_id, LAG(driver_id) OVER (PARTITION BY session_id ORDER BY position, driver_id) AS ahead FROM last),
sc AS (SELECT session_id, driver_id, undercut_score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, driver_id ORDER BY predicted_at DESC, id DESC) AS r FROM predictions) WHERE r = 1)
SELECT user_id, pr.session_id, 'UNDERCUT_THREAT' AS alert_type, pr.driver_id,
  'Undercut threat: driver ' || pr.driver_id || ' on driver ' || ahead || ' (' || CAST(ROUND(undercut_score * 100) AS INT) || '%)' AS message
FROM pr JOIN sc ON sc.session_id = pr.session_id AND sc.driver_id = pr.driver_id JOIN subs s ON s.driver_id = pr.driver_id
WHERE ahead IS NOT NULL AND undercut_score > 0.5 AND NOT pit_only
""")
def r09(spark, root):
    return alerts.undercut_threats(v.laps(spark, root), predictions(spark, root), subscriptions(spark, root))


RULES = (
    rules.Rule("high_latency_p95", "p95", 360, 60, 3.0, True, 120),
    rules.Rule("high_error_rate", "error_ratio", 180, 60, 0.2, True, 180),
    rules.Rule("low_hit_rate", "hit_rate", 720, 60, 0.66, False, 240),
)


def _window_sql(rule: rules.Rule, value: str) -> str:
    n = rule.size_minutes // rule.slide_minutes
    sign = ">" if rule.above else "<"
    return f"""SELECT '{rule.name}' AS rule, w, CAST({value} AS DOUBLE) AS value, COALESCE({value} {sign} {rule.limit}, FALSE) AS firing
  FROM (SELECT *, UNNEST(range(0, {n})) AS i, date_trunc('hour', ts) AS pane FROM request_log) CROSS JOIN LATERAL (SELECT pane - to_minutes(CAST(i * {rule.slide_minutes} AS BIGINT)) AS w) GROUP BY w"""


def _p95_sql() -> str:
    """Quantile of bucket counts as nested CASE."""
    bounds = rules.LATENCY_BUCKETS
    rank, out = "95e-2 * COUNT(latency_s)", f"{bounds[-1]}::DOUBLE"
    for i in reversed(range(len(bounds))):
        within = f"COUNT(*) FILTER (latency_s <= {bounds[i]!r}::DOUBLE)"
        low, before = (bounds[i - 1], f"COUNT(*) FILTER (latency_s <= {bounds[i - 1]!r}::DOUBLE)") if i else (0.0, "0")
        out = f"CASE WHEN {within} >= {rank} THEN {low!r}::DOUBLE + {bounds[i] - low!r}::DOUBLE * ({rank} - {before}) / ({within} - {before}) ELSE {out} END"
    return out


RULES_SQL = ", windows AS (" + " UNION ALL ".join(
    _window_sql(r, e)
    for r, e in zip(RULES, (_p95_sql(), "AVG((status >= 500)::INT)", "AVG(cache_hit::INT)"))
) + ")"


def _at(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query("r10_window_rules", RULES_SQL + "SELECT rule, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, ROUND(value, 6) AS value, firing FROM windows")
def r10(spark, root):
    rows = rules.window_rules(v.request_log(spark, root), RULES)
    return rows.select("rule", _at("window_start"), F.round("value", 6).alias("value"), "firing")


@query("r10_window_rule_stream", RULES_SQL + "SELECT rule, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, ROUND(value, 6) AS value, firing FROM windows")
def r10_stream(spark, root):
    log = v.request_log(spark, root).withColumn("ts", F.col("ts").cast("timestamp"))
    out = None
    for rule in RULES:
        path = new_path(spark, "r10")
        in_parts(
            spark, [log.filter("ts < '2024-01-15'"), log.filter("ts >= '2024-01-15'")],
            lambda s, rule=rule, path=path: live.store_updates(rules.window_rule_stream(s, rule), path),
        )
        rows = live.read_updates(spark, path, ["rule", "window_start"])
        out = rows if out is None else out.unionByName(rows)
    return out.select("rule", _at("window_start"), F.round("value", 6).alias("value"), "firing")


@query("r10_late_rows_stream", RULES_SQL + "SELECT rule, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, ROUND(value, 6) AS value, firing FROM windows")
def r10_late(spark, root):
    """Rows days late correct their windows: the newer half of the log comes first, one row in five of it last."""
    log = v.request_log(spark, root).withColumn("ts", F.col("ts").cast("timestamp"))
    last = F.col("event_id") % 5 == 0
    parts = [log.filter((F.col("ts") >= "2024-01-15") & ~last), log.filter(F.col("ts") < "2024-01-15"), log.filter((F.col("ts") >= "2024-01-15") & last)]
    out = None
    for rule in RULES:
        path = new_path(spark, "r10l")
        in_parts(spark, parts, lambda s, rule=rule, path=path: rules.window_rule_updates(s, rule, path, every=2))
        rows = live.read_updates(spark, path, ["rule", "window_start"])
        out = rows if out is None else out.unionByName(rows)
    return out.select("rule", _at("window_start"), F.round("value", 6).alias("value"), "firing")


SUSTAINED_SQL = RULES_SQL + """
, need AS (SELECT * FROM (VALUES ('high_latency_p95', 120, 360), ('high_error_rate', 180, 180), ('low_hit_rate', 240, 720)) t(rule, minutes, size)),
fired AS (SELECT rule, w, w - to_hours(ROW_NUMBER() OVER (PARTITION BY rule ORDER BY w)) AS island FROM windows WHERE firing),
since AS (SELECT rule, w, MIN(w) OVER (PARTITION BY rule, island) AS since FROM fired)
SELECT a.rule, strftime(a.w, '%Y-%m-%d %H:%M:%S') AS window_start, a.firing, strftime(since, '%Y-%m-%d %H:%M:%S') AS firing_since, COALESCE(since + to_minutes(minutes) <= a.w, FALSE) AS sustained
FROM windows a LEFT JOIN since s ON s.rule = a.rule AND s.w = a.w LEFT JOIN need n ON n.rule = a.rule
"""


@query("r11_sustained_stream", SUSTAINED_SQL + "WHERE a.w + to_minutes(size) <= (SELECT MAX(ts) FROM request_log) - to_minutes(10)")
def r11_stream(spark, root):
    """Windows the watermark has closed, in two parts with a restart between them."""
    log = v.request_log(spark, root).withColumn("ts", F.col("ts").cast("timestamp"))
    out = None
    for rule in RULES:
        path = new_path(spark, "r11")
        in_parts(
            spark, [log.filter("ts < '2024-01-15'"), log.filter("ts >= '2024-01-15'")],
            lambda s, rule=rule, path=path: rules.sustained_stream(s, rule, path),
        )
        rows = live.read_batches(spark, f"{path}/windows")
        out = rows if out is None else out.unionByName(rows)
    return out.select("rule", _at("window_start"), "firing", _at("firing_since"), "sustained")


@query("r11_sustained", RULES_SQL + """
, need AS (SELECT * FROM (VALUES ('high_latency_p95', 120), ('high_error_rate', 180), ('low_hit_rate', 240)) t(rule, minutes)),
fired AS (SELECT rule, w, w - to_hours(ROW_NUMBER() OVER (PARTITION BY rule ORDER BY w)) AS island FROM windows WHERE firing),
since AS (SELECT rule, w, MIN(w) OVER (PARTITION BY rule, island) AS since FROM fired)
SELECT a.rule, strftime(a.w, '%Y-%m-%d %H:%M:%S') AS window_start, a.firing, strftime(since, '%Y-%m-%d %H:%M:%S') AS firing_since, COALESCE(since + to_minutes(minutes) <= a.w, FALSE) AS sustained
FROM windows a LEFT JOIN since s ON s.rule = a.rule AND s.w = a.w LEFT JOIN need n ON n.rule = a.rule
""")
def r11(spark, root):
    rows = rules.sustained(rules.window_rules(v.request_log(spark, root), RULES), RULES)
    return rows.select("rule", _at("window_start"), "firing", _at("firing_since"), "sustained")


@query("s08_replay_stream", """
SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(driver_id AS VARCHAR) AS driver_id, lap_number, ROUND(lap_ms / 1000.0, 6) AS lap_time_seconds,
  ROW_NUMBER() OVER (ORDER BY lap_number, CAST(driver_id AS VARCHAR), session_id) AS seq FROM laps WHERE lap_ms IS NOT NULL
""")
def s08(spark, root):
    """All stored sessions replayed together as a stream."""
    folder, out = feed.replay_laps(lap_records(spark, root), batches=4), new_path(spark, "s08")
    feed.replay_stream(spark, folder, lambda b, i: live.write_batch(b, f"{out}/rows", i), f"{out}/checkpoint", 4)
    # ``seq`` is the order of arrival: by batch, and inside a batch by lap and driver.
    arrived = ordered.over_order(live.read_batches(spark, f"{out}/rows").drop("seq"), [], ["batch_id", "lap_number", "driver_id", "session_id"], rank="seq")
    return arrived.select("session_id", "driver_id", "lap_number", "lap_time_seconds", "seq")


@query("s11_alert_rows", SUBSCRIPTIONS_SQL + """
SELECT user_id, s.driver_id, COUNT(*) AS alerts, COUNT(*) AS ids FROM subs s JOIN (SELECT DISTINCT session_id, driver_id FROM laps) l ON l.driver_id = s.driver_id GROUP BY 1, 2
""")
def s11(spark, root):
    """One alert per follower and session, each with an id of its own."""
    from paddock.operators.joins import match_subscriptions

    events = v.laps(spark, root).select(*DRIVER).distinct().withColumns({"alert_type": F.lit("PIT_WINDOW_OPEN"), "message": F.lit("box")})
    path = new_path(spark, "s11")
    alerts.write_alerts(match_subscriptions(events, subscriptions(spark, root)), NOW, path, 0)
    rows = live.read_batches(spark, f"{path}/alerts")
    return rows.groupBy("user_id", "driver_id").agg(F.count(F.lit(1)).alias("alerts"), F.countDistinct("id").alias("ids"))


@query("t04_upcoming_sessions", """
, s AS (SELECT o_orderkey AS round, o_orderdate AS d FROM orders),
all_starts AS (SELECT round, 'FP1' AS session_type, d + INTERVAL 9 HOUR AS start, 0 AS i FROM s UNION ALL SELECT round, 'Q', d, 3 FROM s UNION ALL SELECT round, 'R', d + INTERVAL 1 DAY + INTERVAL 14 HOUR, 4 FROM s)
SELECT round, session_type, strftime(start, '%Y-%m-%d %H:%M:%S') AS start FROM all_starts WHERE start >= TIMESTAMP '1996-01-02 13:55:00' AND start <= TIMESTAMP '1996-01-02 14:05:00' ORDER BY round, i LIMIT 1
""")
def t04(spark, root):
    from paddock.operators.reshape import upcoming_sessions

    day = F.col("o_orderdate").cast("date")
    plan = v.read(spark, root, "orders").select(
        F.col("o_orderkey").alias("round"), day.alias("fp1Date"), F.lit("09:00:00").alias("fp1Time"), day.alias("qualifyingDate"),
        F.lit(None).cast("string").alias("qualifyingTime"), F.date_add(day, 1).alias("raceDate"), F.lit("14:00:00").alias("raceTime"),
    )
    rows = upcoming_sessions(plan, datetime(1996, 1, 2, 13, 55))
    return rows.select("round", "session_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("t05_top_contributions", """
, l AS (SELECT session_id, driver_id, lap_number, [sector1_ms - 30000, 40000 - sector2_ms, sector3_ms - 30000] AS c, ['a', 'b', 'c'] AS n FROM laps WHERE sector1_ms IS NOT NULL),
u AS (SELECT session_id, driver_id, lap_number, UNNEST(c) AS c, UNNEST(n) AS n FROM l),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, driver_id, lap_number ORDER BY ABS(c) DESC, n) AS r FROM u)
SELECT session_id, driver_id, lap_number, string_agg(n || CASE WHEN c >= 0 THEN '+' ELSE '-' END, ',' ORDER BY r) AS top FROM r WHERE r <= 2 GROUP BY 1, 2, 3
""")
def t05(spark, root):
    from paddock.operators.reshape import top_contributions

    def part(name: str, value):
        return F.struct(F.lit(name).alias("feature"), value.cast("double").alias("value"), value.cast("double").alias("contribution"))

    rows = v.laps(spark, root).filter("sector1_ms is not null").select(
        *LAP,
        F.array(part("a", F.col("sector1_ms") - 30000), part("b", 40000 - F.col("sector2_ms")), part("c", F.col("sector3_ms") - 30000)).alias("contributions"),
    )
    shown = F.transform("contributions", lambda e: F.concat(e["feature"], e["direction"]))
    return top_contributions(rows, 2).withColumn("top", F.array_join(shown, ",")).select(*LAP, "top")
