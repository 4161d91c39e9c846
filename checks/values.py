"""Scalar functions on values derived from the lap tables."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import query
from checks.relational import LAP, PREDICTIONS_SQL, predictions, rounded, secs, with_season
from paddock.functions import scalars
from paddock.operators import aggregates as agg
from paddock.sources import feed, ingest
from paddock.sources import lapview as v


@query("p01_parse_lap_time", """
SELECT session_id, driver_id, lap_number, CASE lap_number % 5 WHEN 0 THEN lap_ms / 1000.0 WHEN 1 THEN lap_ms / 1000.0 WHEN 4 THEN 1.0 END AS seconds FROM laps
""")
def p01(spark, root):
    ms = F.col("lap_ms")
    clock = F.concat(
        F.floor(ms / 60000).cast("string"), F.lit(":"), F.format_string("%06.3f", (ms % 60000) / 1000.0)
    )
    plain = (ms / 1000.0).cast("string")
    kind = F.col("lap_number") % 5
    text = F.when(kind == 0, clock).when(kind == 1, plain).when(kind == 2, "").when(kind == 3, "abc").otherwise("1:02:03")
    return v.laps(spark, root).select(*LAP, F.round(scalars.parse_lap_time(text), 6).alias("seconds"))


@query("p02_parse_temp", """
SELECT session_id, driver_id, lap_number, CASE WHEN lap_number % 4 <> 1 THEN track_temp + 0.5 END AS temp FROM laps
""")
def p02(spark, root):
    text = F.when(F.col("lap_number") % 4 == 1, "n/a").otherwise((F.col("track_temp") + 0.5).cast("string"))
    return v.laps(spark, root).select(*LAP, scalars.parse_temp(text).alias("temp"))


def entries(spark, root) -> DataFrame:
    """One car entry per lap; every seventh lap has no channels."""
    lap = F.col("lap_number")
    drs = F.element_at(F.array(*[F.lit(x) for x in (0, 8, 10, 14, 99)]), (lap % 5 + 1).cast("int"))
    channels = F.map_filter(
        F.create_map(
            F.lit("2"), (F.col("sector2_ms") / 100).cast("double"), F.lit("3"), (lap % 8).cast("double"),
            F.lit("4"), (F.col("driver_id") % 101).cast("double"), F.lit("5"), (lap % 2).cast("double"),
            F.lit("45"), F.when(lap % 6 != 0, drs).cast("double"),
        ),
        lambda _, x: x.isNotNull(),
    )
    entry = F.when(lap % 7 == 0, F.lit('{"Channels": 5}')).otherwise(F.to_json(F.struct(channels.alias("Channels"))))
    return v.laps(spark, root).withColumn("entry", entry)


CHANNEL_SQL = """
  CASE WHEN lap_number % 7 <> 0 THEN ROUND(sector2_ms / 100.0, 6) END AS speed_kmh, CASE WHEN lap_number % 7 <> 0 THEN CAST(lap_number % 8 AS INT) END AS gear,
  CASE WHEN lap_number % 7 <> 0 THEN CAST(driver_id % 101 AS DOUBLE) END AS throttle_pct, CASE WHEN lap_number % 7 <> 0 THEN lap_number % 2 <> 0 END AS brake,
  CASE WHEN lap_number % 7 <> 0 AND lap_number % 6 <> 0 THEN ['off', 'available', 'enabled', 'open', 'unknown'][lap_number % 5 + 1] END AS drs
"""


@query("p03_decode_channels", f"SELECT session_id, driver_id, lap_number, {CHANNEL_SQL} FROM laps")
def p03(spark, root):
    rows = entries(spark, root).select(*LAP, scalars.decode_channels("entry").alias("c")).select(*LAP, "c.*")
    return rounded(rows, "speed_kmh")


@query("p04_drs_status", """
SELECT session_id, driver_id, lap_number, CASE tyre_age_laps WHEN 0 THEN 'off' WHEN 2 THEN 'available' WHEN 4 THEN 'enabled' ELSE 'unknown' END AS status
FROM laps
""")
def p04(spark, root):
    age = F.col("tyre_age_laps")
    code = F.when(age == 0, 0).when(age == 2, 8).when(age == 4, 10).otherwise(99)
    return v.laps(spark, root).select(*LAP, scalars.drs_status(code).alias("status"))


@query("p05_normalize_json", """
SELECT session_id, driver_id, lap_number, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS at_text,
  CASE WHEN lap_number % 3 <> 0 THEN lap_ms / 1000.0 END AS value, lap_ms / 1000.0 AS took, sector2_ms / 1000.0 AS part FROM laps
""")
def p05(spark, root):
    raw = v.laps(spark, root).select(
        *LAP, "created_at",
        F.when(F.col("lap_number") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("lap_ms") / 1000.0).alias("value"),
        F.make_dt_interval(secs=F.col("lap_ms") / 1000.0).alias("took"),
        F.struct(F.array(F.make_dt_interval(secs=F.col("sector2_ms") / 1000.0)).alias("parts")).alias("nested"),
    )
    rows = scalars.normalize_json(raw)
    return rows.select(
        *LAP, F.substring("created_at", 1, 19).alias("at_text"), "value", "took",
        F.get("nested.parts", F.lit(0)).alias("part"),
    )


@query("p06_compound_code", """
SELECT session_id, driver_id, lap_number, CASE WHEN lap_number % 6 = 0 THEN 2 ELSE CASE compound WHEN 'HARD' THEN 0 WHEN 'INTERMEDIATE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'SOFT' THEN 3 ELSE 4 END END AS code,
  CASE WHEN lap_number % 6 = 0 THEN 'medium' WHEN compound = 'INTERMEDIATE' THEN 'inter' ELSE lower(compound) END AS model FROM laps
""")
def p06(spark, root):
    seen = F.when(F.col("lap_number") % 6 == 0, "UNKNOWN").otherwise(F.col("compound"))
    return v.laps(spark, root).select(
        *LAP, scalars.compound_code(seen).alias("code"), scalars.compound_model(seen).alias("model")
    )


@query("p08_stable_code", """
, b AS (SELECT DISTINCT session_id, driver_id, list_transform(string_split(CAST(driver_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM laps)
SELECT driver_id, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
  lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END)), CAST(4294967295 AS BIGINT)) % 1000 AS INT) AS code FROM b
""")
def p08(spark, root):
    return agg.roster(v.laps(spark, root)).select("driver_id", scalars.stable_code("driver_id").alias("code"))


@query("p10_fuel_features", """
, l AS (SELECT *, MAX(lap_number) OVER (PARTITION BY session_id) AS n FROM laps)
SELECT session_id, driver_id, lap_number, ROUND(110 * (1 - lap_number / n), 6) AS fuel_at_lap,
  ROUND(lap_ms / 1000.0 - 0.03 * (110 - 110 * (1 - lap_number / n)), 6) AS fuel_adjusted_time, ROUND(GREATEST(110 * (1 - lap_number / n), 0), 6) AS fuel_load_est FROM l
""")
def p10(spark, root):
    held = agg.laps_in_session(v.laps(spark, root)).withColumn("lap_time_seconds", F.col("lap_ms") / 1000.0)
    rows = scalars.fuel_features(held)
    names = ("fuel_at_lap", "fuel_adjusted_time", "fuel_load_est")
    return rounded(rows.select(*LAP, *names), *names)


@query("p11_fuel_features_forward", """
, l AS (SELECT *, MAX(lap_number) OVER (PARTITION BY session_id) AS n FROM laps)
SELECT session_id, driver_id, lap_number, ROUND(-0.03 * (110 - 110 * (1 - lap_number / n)), 6) AS fuel_adjusted_time FROM l
""")
def p11(spark, root):
    rows = scalars.fuel_features_forward(agg.laps_in_session(v.laps(spark, root)), race_laps="laps_in_session")
    return rounded(rows.select(*LAP, "fuel_adjusted_time"), "fuel_adjusted_time")


@query("p12_track_flags", """
SELECT session_id, driver_id, lap_number, COALESCE(track_status LIKE '%4%' OR track_status LIKE '%6%' OR track_status LIKE '%7%', FALSE) AS sc, compound IN ('INTERMEDIATE', 'WET') AS wet FROM laps
""")
def p12(spark, root):
    return v.laps(spark, root).select(*LAP, scalars.is_sc("track_status").alias("sc"), scalars.is_wet("compound").alias("wet"))


@query("p14_validate_plans", """
SELECT session_id, driver_id, stint_number, stint_number <> 2 AS length_ok, CASE WHEN stint_number % 3 = 0 THEN 'HYPER,ULTRA' ELSE '' END AS unknown, stint_number <> 2 AND stint_number % 3 <> 0 AS ok FROM stints
""")
def p14(spark, root):
    """A plan per stint: first stints have no stops, second ones a compound too few."""
    n, start = F.col("stint_number"), F.col("start_lap")
    odd = F.array(F.lit("ULTRA"), F.lit("HYPER"))
    rows = v.stints(spark, root).select(
        "session_id", "driver_id", "stint_number",
        F.when(n == 1, F.array().cast("array<int>")).otherwise(F.array(start, start + 5)).alias("pit_laps"),
        F.when(n % 3 == 0, odd).when(n == 2, F.array("compound")).otherwise(F.array("compound", F.lit("SOFT"))).alias("compounds"),
    )
    checked = scalars.validate_plans(rows)
    return checked.select("session_id", "driver_id", "stint_number", "length_ok", F.array_join("unknown_compounds", ",").alias("unknown"), "ok")


@query("p15_key_pattern", """
SELECT event_id, 'live:*:' || CASE WHEN event_id % 2 = 0 THEN '*' ELSE 'driver' END || ':*:gaps' AS pattern FROM request_log
""")
def p15(spark, root):
    middle = F.when(F.col("event_id") % 2 == 0, F.substring(F.md5(F.col("event_id").cast("string")), 1, 12)).otherwise("driver")
    key = F.concat_ws(":", F.lit("live"), F.lit("2025"), middle, F.col("event_id").cast("string"), F.lit("gaps"))
    return v.request_log(spark, root).select("event_id", scalars.key_pattern(key).alias("pattern"))


@query("p16_alert_text", PREDICTIONS_SQL + """
SELECT session_id, driver_id, id, 'Undercut threat: driver ' || driver_id || ' on driver ' || (driver_id + 1) || ' (' || ((id * 37 + driver_id * 11) % 100) || '%)' AS message,
  'Tyre age ' || CASE WHEN (id % 9) - 4 >= 0 THEN '+' ELSE '' END || printf('%.2f', (id % 9 - 4) / 4e0) || ' s' AS reason FROM predictions
""")
def p16(spark, root):
    part = (F.col("id") % 9 - 4) / 4.0
    return predictions(spark, root).select(
        "session_id", "driver_id", "id",
        scalars.alert_message("driver_id", F.col("driver_id") + 1, "undercut_score").alias("message"),
        scalars.format_contribution(F.lit("tyre_age_laps"), part, "s").alias("reason"),
    )


@query("p17_season_split", """
SELECT l.session_id, driver_id, lap_number, CASE WHEN season <= 2024 THEN 'train' ELSE 'holdout' END AS part FROM laps l JOIN context c ON c.session_id = l.session_id WHERE lap_ms IS NOT NULL
""")
def p17(spark, root):
    train, holdout = scalars.season_split(with_season(spark, root, v.laps(spark, root)), time="lap_ms")
    return train.select(*LAP, F.lit("train").alias("part")).unionByName(holdout.select(*LAP, F.lit("holdout").alias("part")))


@query("p18_optimal_pit_lap", """
SELECT session_id, driver_id, lap_number, CAST(lap_number + GREATEST(CAST(TRUNC(sector1_ms / 5000.0 - 5) AS INT), 1) AS INT) AS optimal_pit_lap FROM laps WHERE sector1_ms IS NOT NULL
""")
def p18(spark, root):
    ahead = F.col("sector1_ms") / 5000.0 - 5
    return v.laps(spark, root).filter("sector1_ms is not null").select(*LAP, scalars.optimal_pit_lap("lap_number", ahead).alias("optimal_pit_lap"))


@F.pandas_udf(T.StringType())
def deflate_text(text: pd.Series) -> pd.Series:
    def one(t: str) -> str:
        packer = zlib.compressobj(wbits=-zlib.MAX_WBITS)
        return base64.b64encode(packer.compress(t.encode()) + packer.flush()).decode()

    return text.map(one)


@query("p19_inflate_cars", f"""
SELECT session_id, driver_id, lap_number, CAST(driver_id AS VARCHAR) AS car_number, FALSE AS rejected, {CHANNEL_SQL} FROM laps WHERE lap_number % 9 <> 0
UNION ALL SELECT session_id, driver_id, lap_number, NULL, TRUE, NULL, NULL, NULL, NULL, NULL FROM laps WHERE lap_number % 9 = 0
""")
def p19(spark, root):
    """A payload per lap; every ninth is broken, every seventh car has no channels."""
    entry = F.when(F.col("lap_number") % 7 == 0, "{}").otherwise(F.col("entry"))
    message = F.format_string('{"Cars": {"%s": %s}}', F.col("driver_id").cast("string"), entry)
    packed = entries(spark, root).select(
        *LAP, F.when(F.col("lap_number") % 9 == 0, "not deflate").otherwise(deflate_text(message)).alias("payload")
    )
    cars, rejects = feed.inflate_cars(packed)
    fields = ("speed_kmh", "gear", "throttle_pct", "brake", "drs")
    good = cars.select(*LAP, "car_number", F.lit(False).alias("rejected"), scalars.channel_fields(F.col("entry.Channels")).alias("c"))
    rows = good.select(*LAP, "car_number", "rejected", *[f"c.{f}" for f in fields]).unionByName(
        rejects.select(*LAP, F.lit(True).alias("rejected")), allowMissingColumns=True
    )
    return rounded(rows, "speed_kmh")


@query("p20_validate_laps", """
SELECT driver_id, lap_number, session_id % 10 AS session_number, CASE WHEN lap_number % 10 = 1 THEN 'session_id' WHEN lap_number % 10 = 2 THEN 'lap_number' WHEN lap_number % 10 = 3 THEN 'compound' WHEN lap_number % 10 = 4 THEN 'sector1_seconds' END AS reason,
  CASE WHEN lap_number % 10 IN (1, 2, 3, 4) THEN NULL WHEN lap_number % 10 = 5 THEN 0 ELSE tyre_age_laps END AS tyre_age_laps FROM laps
""")
def p20(spark, root):
    kind = F.col("lap_number") % 10

    def uid(n):
        return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))

    raw = v.laps(spark, root).select(
        F.col("driver_id").alias("n_driver"), F.col("lap_number").alias("n_lap"), F.col("session_id").alias("n_session"),
        F.when(kind == 1, "session").otherwise(uid(F.col("session_id"))).alias("session_id"), uid(F.col("driver_id")).alias("driver_id"),
        F.when(kind != 2, F.col("lap_number").cast("string")).alias("lap_number"), F.when(kind != 3, F.col("compound")).alias("compound"),
        F.when(kind != 5, F.col("tyre_age_laps").cast("string")).alias("tyre_age_laps"), (F.col("lap_ms") / 1000.0).alias("lap_time_seconds"),
        F.when(kind == 4, "fast").otherwise((F.col("sector1_ms") / 1000.0).cast("string")).alias("sector1_seconds"),
    )
    ok, rejects = ingest.validate_laps(raw)

    def number(c: str):
        return F.substring(c, -12, 12).cast("bigint")

    good = ok.select(number("driver_id").alias("driver_id"), F.col("lap_number"), number("session_id").cast("int").alias("session_number"),
                     F.lit(None).cast("string").alias("reason"), "tyre_age_laps")
    bad = rejects.select(F.col("n_driver").alias("driver_id"), F.col("n_lap").alias("lap_number"), F.col("n_session").alias("session_number"), "reason",
                         F.lit(None).cast("int").alias("tyre_age_laps"))
    return good.unionByName(bad)


@query("s09_lap_event_json", """
SELECT CAST(driver_id AS VARCHAR) AS driver_id, CAST(session_id AS VARCHAR) AS session_id, lap_number, lap_ms / 1000.0 AS lap_time_seconds, compound, sector1_ms / 1000.0 AS sector1_seconds, 8 AS fields FROM laps
""")
def s09(spark, root):
    events = feed.lap_event_json(lap_records(spark, root))
    schema = "driver_id string, session_id string, lap_number int, lap_time_seconds double, compound string, sector1_seconds double"
    return events.select(F.from_json("value", schema).alias("e"), F.size(F.json_object_keys("value")).alias("fields")).select("e.*", "fields")


def lap_records(spark, root) -> DataFrame:
    """Laps in the column names of the lap table."""
    return v.laps(spark, root).select(
        F.col("session_id").cast("string").alias("session_id"), F.col("driver_id").cast("string").alias("driver_id"), "lap_number",
        secs("lap_ms").alias("lap_time_seconds"), "compound", "tyre_age_laps", "is_valid", "position", "track_status",
        *[secs(f"sector{i}_ms").alias(f"sector{i}_seconds") for i in (1, 2, 3)],
        F.col("track_temp").cast("double").alias("track_temp"), F.col("air_temp").cast("double").alias("air_temp"),
        F.col("created_at").cast("timestamp").alias("created_at"),
    )
