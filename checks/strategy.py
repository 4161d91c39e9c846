"""Projection, pit windows, undercut, safety car and pit plans with a fixed linear score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import query
from checks.relational import DRIVER, LAP, RATES_SQL, circuit_flags, with_season
from paddock.functions import scalars
from paddock.operators import aggregates as agg
from paddock.operators import joins, windows
from paddock.plans import pitstops, projection, safetycar, undercut, whatif
from paddock.sources import lapview as v


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 8) for n in names})


def tyre_score(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumn(
        "prediction",
        0.02 * c("compound_encoded") + 0.06 * c("tyre_age_laps") - 0.001 * c("lap_number")
        + 0.01 * c("fuel_adjusted_time") + 0.0001 * c("circuit_id_encoded") + 0.0001 * c("driver_id_encoded"),
    )


def pit_score(df: DataFrame) -> DataFrame:
    c = F.col
    raw = (
        0.02 * c("current_tyre_age") + 0.01 * (40 - c("predicted_life_remaining")) - 0.001 * c("gap_to_car_ahead")
        + 0.2 * c("safety_car_probability") + 0.001 * c("laps_to_race_end") - 0.001 * c("position")
    )
    return df.withColumn("prediction", F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def fuel_sql(lap: str, total: str) -> str:
    return f"(-3e-2 * (110e0 - 110e0 * (1 - ({lap}) / CAST(GREATEST({total}, 1) AS DOUBLE))))"


def tyre_sql(code: str, age: str, lap: str, fuel: str) -> str:
    return f"(2e-2 * ({code}) + 6e-2 * ({age}) - 1e-3 * ({lap}) + 1e-2 * ({fuel}) + 1e-4 * circuit_code + 1e-4 * driver_code)"


def pit_sql(age: str, life: str, gap: str, sc: str, left: str, position: str) -> str:
    return (
        f"LEAST(1e0, GREATEST(0e0, 2e-2 * ({age}) + 1e-2 * (40 - ({life})) - 1e-3 * ({gap}) + 2e-1 * ({sc})"
        f" + 1e-3 * ({left}) - 1e-3 * ({position})))"
    )


def code_sql(compound: str) -> str:
    return f"CASE {compound} WHEN 'HARD' THEN 0 WHEN 'INTERMEDIATE' THEN 1 WHEN 'SOFT' THEN 3 WHEN 'WET' THEN 4 ELSE 2 END"


def cdf_sql(x: str) -> str:
    z = f"(ABS({x}) / SQRT(2e0))"
    t = f"(1 / (1 + 3.275911e-1 * {z}))"
    poly = f"{t} * (2.54829592e-1 + {t} * (-2.84496736e-1 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0))))"
    return f"(5e-1 * (1 + SIGN({x}) * (1 - {poly} * EXP(-{z} * {z}))))"


STATE_SQL = f"""
, state AS (SELECT l.session_id, driver_id, lap_number, compound, tyre_age_laps, position, total_laps, circuit_id AS circuit_code,
    CAST(driver_id % 1000 AS INT) AS driver_code, {code_sql('compound')} AS code
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, driver_id ORDER BY lap_number DESC) AS r, MAX(lap_number) OVER (PARTITION BY session_id) AS total_laps FROM laps) l
  JOIN context c ON c.session_id = l.session_id WHERE r = 1),
elapsed AS (SELECT session_id, driver_id, COALESCE(SUM(lap_ms), 0) / 1000.0 AS elapsed FROM laps GROUP BY 1, 2)
"""


def state(spark, root) -> DataFrame:
    ctx = v.context(spark, root).select("session_id", "circuit_id", F.col("circuit_id").alias("circuit_code"))
    rows = projection.current_state(v.laps(spark, root), ctx)
    return rows.withColumn("driver_code", (F.col("driver_id") % 1000).cast("int"))


def elapsed(spark, root) -> DataFrame:
    held = agg.elapsed_time(v.laps(spark, root), time="lap_ms")
    return held.withColumn("elapsed", F.col("elapsed") / 1000.0)


@query("g01_current_state", STATE_SQL + """
SELECT session_id, driver_id, lap_number, compound, tyre_age_laps, position, total_laps, circuit_code AS circuit_id FROM state
""")
def g01(spark, root):
    return state(spark, root).select(*LAP, "compound", "tyre_age_laps", "position", "total_laps", "circuit_id")


def stints_ahead(spark, root) -> DataFrame:
    """All laps left from the current one; drivers on the last lap have none."""
    return projection.spread(state(spark, root), DRIVER).select(
        *DRIVER, (F.col("lap_number") + 1).alias("start_lap"),
        (F.col("total_laps") - F.col("lap_number")).alias("n_laps"),
        F.col("tyre_age_laps").alias("start_age"), "total_laps", "compound", "circuit_code", "driver_code",
    )


EXPAND_SQL = STATE_SQL + f"""
, expanded AS (SELECT session_id, driver_id, lap_number + i AS lap_number, code AS compound_encoded, tyre_age_laps + i - 1 AS tyre_age_laps,
    {fuel_sql('lap_number + i', 'total_laps')} AS fuel_adjusted_time, circuit_code, driver_code
  FROM (SELECT *, UNNEST(range(1, total_laps - lap_number + 1)) AS i FROM state))
"""


@query("g02_expand_stint", EXPAND_SQL + """
SELECT session_id, driver_id, CAST(lap_number AS INT) AS lap_number, CAST(compound_encoded AS INT) AS compound_encoded, CAST(tyre_age_laps AS INT) AS tyre_age_laps,
  ROUND(fuel_adjusted_time, 8) AS fuel_adjusted_time, circuit_code AS circuit_id_encoded, driver_code AS driver_id_encoded FROM expanded
""")
def g02(spark, root):
    rows = rounded(projection.expand_stint(stints_ahead(spark, root)), "fuel_adjusted_time").drop("tyre_model")
    return rows.withColumns({c: F.col(c).cast("int") for c in ("lap_number", "compound_encoded", "tyre_age_laps")})


@query("g03_project_stints", EXPAND_SQL + f"""
, sums AS (SELECT session_id, driver_id, SUM({tyre_sql('compound_encoded', 'tyre_age_laps', 'lap_number', 'fuel_adjusted_time')}) AS p FROM expanded GROUP BY 1, 2)
SELECT s.session_id, s.driver_id, ROUND(COALESCE(p, 0), 8) AS projected FROM state s LEFT JOIN sums USING (session_id, driver_id)
""")
def g03(spark, root):
    return rounded(projection.project_stints(stints_ahead(spark, root), DRIVER, tyre_score), "projected")


@query("g04_life_remaining", STATE_SQL + f"""
, p AS (SELECT session_id, driver_id, off, {tyre_sql('code', 'tyre_age_laps + off', 'lap_number + off', fuel_sql('lap_number', 'total_laps'))} AS p
  FROM (SELECT *, UNNEST(range(0, 40)) AS off FROM state))
SELECT session_id, driver_id, CAST(COALESCE(MIN(CASE WHEN p >= 1.5 THEN off END), 40) AS INT) AS life_remaining FROM p GROUP BY 1, 2
""")
def g04(spark, root):
    rows = projection.spread(state(spark, root), DRIVER).select(
        *DRIVER, "lap_number", scalars.compound_code("compound").alias("compound_encoded"), "tyre_age_laps",
        scalars.forward_fuel("lap_number", "total_laps").alias("fuel_adjusted_time"),
        F.col("circuit_code").alias("circuit_id_encoded"), F.col("driver_code").alias("driver_id_encoded"),
    )
    return projection.life_remaining(rows, DRIVER, tyre_score)


WINDOW_SQL = STATE_SQL + f"""
, cand AS (SELECT *, UNNEST(range(lap_number + 1, LEAST(lap_number + 15, total_laps) + 1)) AS pit_lap, LEAST(lap_number + 15, total_laps) AS window_end FROM state),
one AS (SELECT session_id, driver_id, pit_lap, SUM({tyre_sql('code', 'tyre_age_laps + i - 1', 'lap_number + i', fuel_sql('lap_number + i', 'total_laps'))}) AS d
  FROM (SELECT *, UNNEST(range(1, pit_lap - lap_number + 1)) AS i FROM cand) GROUP BY 1, 2, 3),
two AS (SELECT session_id, driver_id, pit_lap, c2, SUM({tyre_sql('c2', 'i - 1', 'pit_lap + i', fuel_sql('pit_lap + i', 'total_laps'))}) AS d
  FROM (SELECT *, UNNEST(range(1, total_laps - pit_lap + 1)) AS i FROM (SELECT *, UNNEST([3, 2, 0]) AS c2 FROM cand)) GROUP BY 1, 2, 3, 4),
best AS (SELECT session_id, driver_id, pit_lap, MIN(d) AS d FROM two GROUP BY 1, 2, 3),
total AS (SELECT c.session_id, c.driver_id, c.pit_lap, c.lap_number + 1 AS window_start, c.window_end, one.d + 22 + COALESCE(best.d, 0) AS t
  FROM cand c JOIN one USING (session_id, driver_id, pit_lap) LEFT JOIN best USING (session_id, driver_id, pit_lap)),
windows AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, driver_id ORDER BY ROUND(t, 9), pit_lap) AS r FROM total)
"""


@query("g05_pit_windows", WINDOW_SQL + """
SELECT session_id, driver_id, CAST(pit_lap AS INT) AS pit_lap, CAST(window_start AS INT) AS window_start, CAST(window_end AS INT) AS window_end, ROUND(t, 8) AS projected_total_delta_seconds FROM windows WHERE r <= 3
""")
def g05(spark, root):
    return rounded(pitstops.pit_windows(state(spark, root), tyre_score), "projected_total_delta_seconds")


def crossing_sql(gap: str, sc: str, position: str, source: str) -> str:
    return f"""
, tyre_ahead AS (SELECT session_id, driver_id, m, {tyre_sql('code', 'tyre_age_laps + m', 'lap_number + m', '0e0')} AS p FROM (SELECT *, UNNEST(range(1, 55)) AS m FROM {source})),
offs AS (SELECT *, UNNEST(range(1, LEAST(15, GREATEST(total_laps - lap_number, 1)) + 1)) AS off FROM {source}),
lives AS (SELECT o.session_id, o.driver_id, o.off, COALESCE(MIN(CASE WHEN p >= 1.5 THEN m - o.off END), 40) AS life
  FROM offs o JOIN tyre_ahead t ON t.session_id = o.session_id AND t.driver_id = o.driver_id AND t.m BETWEEN o.off AND o.off + 39 GROUP BY 1, 2, 3),
probs AS (SELECT o.session_id, o.driver_id, o.off, o.lap_number + o.off AS lap,
  {pit_sql('tyre_age_laps + o.off', 'life', gap, sc, 'total_laps - lap_number - o.off', position)} AS p FROM offs o JOIN lives USING (session_id, driver_id, off)),
picked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, driver_id ORDER BY p >= 0.65 DESC, CASE WHEN p >= 0.65 THEN off ELSE -off END) AS r FROM probs),
overview AS (SELECT session_id, driver_id, CAST(lap AS INT) AS predicted_pit_lap, p AS pit_probability FROM picked WHERE r = 1)
"""


GAPPED_SQL = STATE_SQL + """
, last AS (SELECT s.*, e.elapsed FROM state s JOIN elapsed e USING (session_id, driver_id) WHERE position IS NOT NULL),
gapped AS (SELECT *, LEAST(GREATEST(COALESCE(elapsed - LAG(elapsed) OVER (PARTITION BY session_id ORDER BY position, driver_id), 120), 0), 120)::DOUBLE AS gap FROM last)
"""


@query("g06_first_crossing", GAPPED_SQL + crossing_sql("gap", "0.5", "position", "gapped") + """
SELECT session_id, driver_id, predicted_pit_lap, ROUND(pit_probability, 8) AS pit_probability FROM overview
""")
def g06(spark, root):
    held = v.laps(spark, root).withColumn("lap_s", F.col("lap_ms") / 1000.0)
    field = windows.position_context(held, time="lap_s").drop("position", "ahead_driver_id", "behind_driver_id")
    rows = state(spark, root).join(field, DRIVER).withColumn("safety_car_probability", F.lit(0.5))
    return rounded(pitstops.first_crossing(rows, tyre_score, pit_score), "pit_probability")


OVERVIEW_SQL = STATE_SQL + """
, sized AS (SELECT s.*, COALESCE(position, n) AS place FROM state s JOIN (SELECT session_id, COUNT(*) AS n FROM state GROUP BY 1) USING (session_id))
""" + crossing_sql("120", "0", "place", "sized")


@query("g07_strategy_overview", OVERVIEW_SQL + """
SELECT session_id, driver_id, predicted_pit_lap, ROUND(pit_probability, 8) AS pit_probability FROM overview
""")
def g07(spark, root):
    return rounded(pitstops.strategy_overview(state(spark, root), tyre_score, pit_score), "pit_probability")


ROLES_SQL = STATE_SQL + f"""
, now_roles AS (SELECT session_id, driver_id, 22 + SUM({tyre_sql('code', 'i', 'lap_number + 1 + i', fuel_sql('lap_number + 1 + i', 'total_laps'))}) AS pit_now FROM (SELECT *, UNNEST(range(0, 5)) AS i FROM state) GROUP BY 1, 2),
stay AS (SELECT session_id, driver_id, {tyre_sql('code', 'tyre_age_laps', 'lap_number + 1', fuel_sql('lap_number + 1', 'total_laps'))} AS d FROM state),
fresh AS (SELECT session_id, driver_id, SUM({tyre_sql('code', 'i', 'lap_number + 2 + i', fuel_sql('lap_number + 2 + i', 'total_laps'))}) AS d FROM (SELECT *, UNNEST(range(0, 4)) AS i FROM state) GROUP BY 1, 2),
roles AS (SELECT n.session_id, n.driver_id, pit_now, 22 + s.d + f.d AS pit_next, elapsed FROM now_roles n JOIN stay s USING (session_id, driver_id) JOIN fresh f USING (session_id, driver_id) JOIN elapsed e USING (session_id, driver_id)),
pairs AS (SELECT * FROM (SELECT session_id, driver_id, LAG(driver_id) OVER (PARTITION BY session_id ORDER BY position, driver_id) AS target_driver_id FROM state WHERE position IS NOT NULL) WHERE target_driver_id IS NOT NULL),
under AS (SELECT p.session_id, p.driver_id, p.target_driver_id, a.elapsed - b.elapsed + a.pit_now - b.pit_next AS mu FROM pairs p
  JOIN roles a ON a.session_id = p.session_id AND a.driver_id = p.driver_id JOIN roles b ON b.session_id = p.session_id AND b.driver_id = p.target_driver_id),
over_ AS (SELECT p.session_id, p.driver_id, p.target_driver_id, a.elapsed - b.elapsed + a.pit_now - b.pit_next AS mu FROM pairs p
  JOIN roles a ON a.session_id = p.session_id AND a.driver_id = p.target_driver_id JOIN roles b ON b.session_id = p.session_id AND b.driver_id = p.driver_id)
"""
NOISE_SQL = "(35e-2 * SQRT(10e0))"


def pairs(spark, root) -> DataFrame:
    return windows.adjacent_pairs(state(spark, root)).withColumnsRenamed(
        {"trailing_driver_id": "driver_id", "ahead_driver_id": "target_driver_id"}
    )


@query("g08_undercut", ROLES_SQL + f"""
SELECT session_id, driver_id, target_driver_id, ROUND({cdf_sql(f'(-mu / {NOISE_SQL})')}, 8) AS probability, ROUND(-mu, 8) AS projected_gap_seconds,
  CASE WHEN {cdf_sql(f'(-mu / {NOISE_SQL})')} >= 0.5 THEN 'PIT NOW' ELSE 'STAY OUT' END AS recommended_action, 5 AS n_laps_projected FROM under
""")
def g08(spark, root):
    held = state(spark, root)
    rows = undercut.undercut(pairs(spark, root), undercut.undercut_roles(held, tyre_score), elapsed(spark, root))
    return rounded(rows, "probability", "projected_gap_seconds")


@query("g08_overcut", ROLES_SQL + f"""
SELECT session_id, driver_id, target_driver_id, ROUND(1 - {cdf_sql(f'(-mu / {NOISE_SQL})')}, 8) AS probability, ROUND(mu, 8) AS projected_gap_seconds, 5 AS n_laps_projected FROM over_
""")
def g08_over(spark, root):
    held = state(spark, root)
    rows = undercut.overcut(pairs(spark, root), undercut.undercut_roles(held, tyre_score), elapsed(spark, root))
    return rounded(rows, "probability", "projected_gap_seconds")


@query("g09_sc_probability", RATES_SQL + """
, lam AS (SELECT l.session_id, driver_id, lap_number,
  COALESCE((SELECT MAX(rate) FROM rates r WHERE r.circuit_name = c.circuit_name), (SELECT MAX(rate) FROM rates WHERE circuit_name IS NULL))
  * CASE WHEN lap_number = 1 THEN 2.5e0 ELSE 1e0 END * CASE WHEN compound IN ('INTERMEDIATE', 'WET') THEN 3e0 ELSE 1e0 END * CASE WHEN circuit_name = 'Circuit de Monaco' THEN 1.8e0 ELSE 1e0 END AS rate
  FROM laps l JOIN context c ON c.session_id = l.session_id)
SELECT session_id, driver_id, lap_number, horizon, ROUND(1 - EXP(-rate * horizon), 8) AS safety_car_probability FROM (SELECT *, UNNEST([1, 2, 3, 5, 10]) AS horizon FROM lam)
""")
def g09(spark, root):
    rates = agg.fit_sc_rates(circuit_flags(spark, root))
    rows = safetycar.sc_probability(with_season(spark, root, v.laps(spark, root)), rates)
    return rounded(rows.select(*LAP, "horizon", "safety_car_probability"), "safety_car_probability")


def plans(spark, root) -> DataFrame:
    """A two-stop plan for every driver, five and nine laps ahead."""
    lap = F.col("lap_number")
    return state(spark, root).select(
        F.concat_ws("-", *DRIVER).alias("plan_id"), *DRIVER,
        F.array(lap + 5, lap + 9).alias("pit_laps"), F.array(F.lit("SOFT"), F.lit("HARD")).alias("compounds"),
    )


PLANS_SQL = OVERVIEW_SQL + f"""
, stops AS (SELECT session_id, driver_id, lap_number + 5 AS p1, lap_number + 9 AS p2, 3 AS c1, 0 AS c2, 1 AS kind FROM state
  UNION ALL SELECT s.session_id, s.driver_id, predicted_pit_lap, NULL, code, NULL, 0 FROM state s JOIN overview USING (session_id, driver_id)),
valid AS (SELECT session_id, driver_id, kind, CASE WHEN p1 > lap_number AND p1 < total_laps THEN p1 END AS p1, CASE WHEN p2 > lap_number AND p2 < total_laps THEN p2 END AS p2, c1, c2,
  lap_number, total_laps, code, tyre_age_laps, circuit_code, driver_code FROM stops JOIN state USING (session_id, driver_id)),
run AS (SELECT *, UNNEST(range(lap_number + 1, total_laps + 1)) AS l FROM valid),
pred AS (SELECT session_id, driver_id, kind, SUM(CASE WHEN p2 IS NOT NULL AND l > p2 THEN {tyre_sql('c2', 'l - p2 - 1', 'l', fuel_sql('l', 'total_laps'))}
  WHEN p1 IS NOT NULL AND l > p1 THEN {tyre_sql('c1', 'l - p1 - 1', 'l', fuel_sql('l', 'total_laps'))}
  ELSE {tyre_sql('code', 'tyre_age_laps + l - lap_number - 1', 'l', fuel_sql('l', 'total_laps'))} END) AS d FROM run GROUP BY 1, 2, 3),
fin AS (SELECT v.session_id, v.driver_id, v.kind, (p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT AS stops, total_laps - lap_number AS laps_left,
  e.elapsed + COALESCE(d, 0) + 22 * ((p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT) AS finish
  FROM valid v JOIN elapsed e USING (session_id, driver_id) LEFT JOIN pred USING (session_id, driver_id, kind))
"""


@query("g10_evaluate_plans", PLANS_SQL + """
SELECT p.session_id, p.driver_id, CAST(p.stops AS INT) AS stops, ROUND(p.finish, 8) AS finish_seconds,
  ROUND(p.finish - 1.6449e0 * 35e-2 * SQRT(p.laps_left), 8) AS low_seconds, ROUND(p.finish + 1.6449e0 * 35e-2 * SQRT(p.laps_left), 8) AS high_seconds,
  CAST(1 + (SELECT COUNT(*) FROM fin r WHERE r.kind = 0 AND r.session_id = p.session_id AND r.driver_id <> p.driver_id AND r.finish < p.finish) AS INT) AS predicted_position
FROM fin p WHERE p.kind = 1
""")
def g10(spark, root):
    held = state(spark, root)
    seen = pitstops.strategy_overview(held, tyre_score, pit_score)
    rows = whatif.evaluate_plans(held, elapsed(spark, root), plans(spark, root), seen, tyre_score)
    return rounded(rows, "finish_seconds", "low_seconds", "high_seconds").select(
        *DRIVER, "stops", "finish_seconds", "low_seconds", "high_seconds", "predicted_position"
    )


@query("g11_sample_finish_times", PLANS_SQL + """
, draws AS (SELECT f.*, UNNEST(range(1, 1001)) AS sim FROM fin f WHERE kind = 1),
u AS (SELECT *, concat_ws('|', '42', CAST(sim AS VARCHAR), CAST(session_id AS VARCHAR), CAST(driver_id AS VARCHAR)) AS k FROM draws),
n AS (SELECT *, (CAST('0x' || substr(md5(k || '|a'), 1, 12) AS BIGINT) + 0.5) / 281474976710656e0 AS u1, (CAST('0x' || substr(md5(k || '|b'), 1, 12) AS BIGINT) + 0.5) / 281474976710656e0 AS u2 FROM u)
SELECT CAST(sim AS INT) AS sim, session_id, driver_id, ROUND(finish + SQRT(-2 * LN(u1)) * COS(2 * PI() * u2) * 35e-2 * SQRT(laps_left), 5) AS finish_time FROM n
""")
def g11(spark, root):
    finishes = whatif.plan_finishes(state(spark, root), elapsed(spark, root), plans(spark, root), tyre_score)
    return whatif.sample_finish_times(finishes).withColumn("finish_time", F.round("finish_time", 5))
