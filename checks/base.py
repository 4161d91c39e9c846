"""Registry of checked queries and the SQL of the lap views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VIEWS = """
WITH ev AS (
  SELECT event_id, user_id AS driver_id, ts,
         CAST(FLOOR((EXTRACT(DAY FROM ts) - 1) / 10) AS INT) AS session_id,
         CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
         60000 + CAST(ROUND(value * 100) AS BIGINT) * 10 AS raw_ms
  FROM events
), numbered AS (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY session_id, driver_id ORDER BY ts, event_id) AS INT) AS lap_number,
         CASE WHEN k % 31 = 0 THEN NULL ELSE raw_ms END AS lap_ms
  FROM ev
), staged AS (
  SELECT *, CAST(FLOOR((lap_number - 1) / (5 + driver_id % 4)) AS INT) + 1 AS stint_number,
         SUM(raw_ms) OVER (PARTITION BY session_id, driver_id ORDER BY lap_number ROWS UNBOUNDED PRECEDING) AS cum_ms,
         CAST(FLOOR(raw_ms * 0.3) AS BIGINT) + k * 10 AS s1, CAST(FLOOR(raw_ms * 0.4) AS BIGINT) AS s2
  FROM numbered
), laps AS (
  SELECT session_id, driver_id, lap_number, stint_number, lap_ms,
    CASE WHEN k % 17 = 0 THEN NULL ELSE s1 END AS sector1_ms, s2 AS sector2_ms, raw_ms - s1 - s2 AS sector3_ms,
    CASE (driver_id + stint_number) % 5 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HARD' WHEN 3 THEN 'INTERMEDIATE' ELSE 'WET' END AS compound,
    CAST((lap_number - 1) % (5 + driver_id % 4) AS INT) AS tyre_age_laps,
    (k % 11 <> 0) AS is_valid,
    CASE WHEN k % 23 = 0 THEN NULL ELSE CAST(ROW_NUMBER() OVER (PARTITION BY session_id, lap_number ORDER BY cum_ms, driver_id) AS INT) END AS position,
    CASE WHEN k % 20 = 0 THEN '4' WHEN k % 20 = 1 THEN '24' WHEN k % 20 = 2 THEN '67' WHEN k % 20 = 3 THEN NULL ELSE '1' END AS track_status,
    CASE WHEN k % 10 = 3 THEN NULL ELSE 20 + k % 30 END AS track_temp,
    CASE WHEN k % 10 = 4 THEN NULL ELSE 15 + k % 15 END AS air_temp,
    ts AS created_at
  FROM staged
), stints AS (
  SELECT session_id, driver_id, stint_number, MIN(compound) AS compound, MIN(lap_number) AS start_lap,
    CASE WHEN driver_id % 7 = 0 AND stint_number > 1 THEN NULL ELSE MAX(lap_number) END AS end_lap
  FROM laps GROUP BY session_id, driver_id, stint_number
), context AS (
  SELECT session_id, 2023 + session_id AS season, CASE WHEN session_id % 2 = 0 THEN 0 ELSE 1 END AS circuit_id,
    CASE WHEN session_id % 2 = 0 THEN 'Circuit de Monaco' ELSE 'Silverstone Circuit' END AS circuit_name
  FROM (SELECT DISTINCT session_id FROM laps) d
), contracts AS (
  SELECT driver_id, driver_id % 10 AS team_id, season
  FROM (SELECT DISTINCT driver_id FROM laps) d CROSS JOIN (SELECT DISTINCT season FROM context) c WHERE driver_id % 13 <> 0
), weather_samples AS (
  SELECT CAST(FLOOR((EXTRACT(DAY FROM ts) - 1) / 10) AS INT) AS session_id, ts AS sample_ts, event_id AS sample_id,
    20 + CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 30 AS track_temp, 15 + CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 15 AS air_temp
  FROM events WHERE event_type = 'view'
), request_log AS (
  SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 25.0 AS latency_s,
    (CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 3 <> 0) AS cache_hit,
    concat('live:2025:', CAST(user_id AS VARCHAR), ':gaps') AS cache_key
  FROM events
)
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB form and may open with more CTEs (", x AS ...")."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = VIEWS + sql
        return fn

    return add


def sec(name: str, digits: int = 6) -> str:
    """SQL text for milliseconds as rounded seconds."""
    return f"ROUND({name} / 1000.0, {digits})"
