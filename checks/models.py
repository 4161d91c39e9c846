"""Fitted models over the lap tables, with the operators' own rounds, depth and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import query
from checks.relational import DRIVER, RATES_SQL, STYLE_SQL, circuit_flags, season_laps, season_stints, with_season
from checks.strategy import GAPPED_SQL, STATE_SQL, fuel_sql, pit_score, pit_sql, rounded, state, tyre_score, tyre_sql
from paddock import fixed
from paddock.functions.scalars import season_split
from paddock.ml import boosting, explain, pits, registry, scoring, styles, training, tyres
from paddock.operators import aggregates as agg
from paddock.operators import encode
from paddock.plans import pitstops
from paddock.scratch import new_path
from paddock.sources import lapview as v


def model_laps(spark, root) -> tuple[DataFrame, dict[str, DataFrame]]:
    held = with_season(spark, root, v.laps(spark, root)).select(
        "session_id", "driver_id", "lap_number", "season", "circuit_id", "circuit_name", "compound",
        "tyre_age_laps", "is_valid", "position", "track_status", "track_temp", "air_temp",
        (F.col("lap_ms") / 1000.0).alias("lap_time_seconds"),
    )
    return held, {c: encode.code_table(held, c) for c in ("circuit_id", "driver_id")}


def _tyres(spark, root) -> tuple[tyres.TyreModels, DataFrame, dict]:
    held, codes = model_laps(spark, root)
    train, holdout = (tyres.tyre_features(part, codes) for part in season_split(held))
    return tyres.fit_tyre_models(train, holdout), train, codes


@query("h01_tyre_models", """
, held AS (SELECT l.*, c.season FROM laps l JOIN context c ON c.session_id = l.session_id WHERE is_valid AND lap_ms IS NOT NULL AND season <= 2024),
d AS (SELECT CASE compound WHEN 'HARD' THEN 'hard' WHEN 'INTERMEDIATE' THEN 'inter' WHEN 'SOFT' THEN 'soft' WHEN 'WET' THEN 'wet' ELSE 'medium' END AS model, session_id,
  lap_ms - MEDIAN(lap_ms) OVER (PARTITION BY session_id, driver_id, compound) AS delta FROM held)
SELECT model, COUNT(*) AS rows, CAST(LEAST(COUNT(DISTINCT session_id), 5) AS INT) AS folds, CAST(SUM(delta) * 1000 AS BIGINT) AS target_sum, COUNT(DISTINCT session_id) > 1 AS crossed, TRUE AS below_mean
FROM d GROUP BY 1
""")
def h01(spark, root):
    """Rows, folds and target sums of each compound's model, and whether its trees beat the mean on the rows they were grown from."""
    models, train, _ = _tyres(spark, root)
    rows = train.filter("lap_time_delta is not null")
    scored = models.score()(rows.select("session_id", "tyre_model", "lap_time_delta", *fixed.TYRE_FEATURES))
    error = F.col("prediction") - F.col("lap_time_delta")
    facts = scored.groupBy(F.col("tyre_model").alias("model")).agg(
        F.count(F.lit(1)).alias("rows"), F.least(F.count_distinct("session_id"), F.lit(5)).cast("int").alias("folds"),
        F.sum(F.round(F.col("lap_time_delta") * 1e6).cast("bigint")).alias("target_sum"),
        (F.avg(error * error) < F.var_pop("lap_time_delta")).alias("below_mean"),
    )
    errors = [(n, m.cv_mae is not None and m.cv_rmse >= m.cv_mae) for n, m in models.by_name.items()]
    return facts.join(F.broadcast(spark.createDataFrame(errors, "model string, crossed boolean")), "model")


def pit_frame(spark, root) -> DataFrame:
    held, codes = model_laps(spark, root)
    rates = agg.fit_sc_rates(circuit_flags(spark, root))
    return pits.pit_training_frame(encode.apply_codes(held, codes), v.stints(spark, root), tyre_score, rates)


@query("h05_training_run", """
, held AS (SELECT l.*, c.season FROM laps l JOIN context c ON c.session_id = l.session_id WHERE lap_ms IS NOT NULL AND season <= 2025),
m AS (SELECT 'tyre_' || CASE compound WHEN 'HARD' THEN 'hard' WHEN 'INTERMEDIATE' THEN 'inter' WHEN 'SOFT' THEN 'soft' WHEN 'WET' THEN 'wet' ELSE 'medium' END AS model_name, season FROM held WHERE is_valid
  UNION ALL SELECT 'safety_car', season FROM held WHERE is_valid UNION ALL SELECT 'pit', season FROM held WHERE position IS NOT NULL)
SELECT model_name, '20240101-000000' AS version, CASE WHEN BOOL_OR(season = 2025) THEN 'holdout' ELSE 'cv_only' END AS promotion_basis, TRUE AS promoted, BOOL_OR(season = 2025) AS with_holdout
FROM m GROUP BY 1 HAVING BOOL_OR(season <= 2024) OR model_name IN ('safety_car', 'pit')
""")
def h05_run(spark, root):
    """A whole training run into an empty store: every model is new, so all are promoted."""
    held, _ = model_laps(spark, root)
    store = registry.ModelStore(spark, new_path(spark, "store"))
    rows = training.train_all(held, v.stints(spark, root), store, "20240101-000000")
    return rows.select("model_name", "version", "promotion_basis", "promoted", F.col("holdout_mae").isNotNull().alias("with_holdout"))


PIT_FRAME_SQL = """
, timed AS (SELECT l.*, c.circuit_name, c.circuit_id AS circuit_code, m.n FROM laps l JOIN context c ON c.session_id = l.session_id
  JOIN (SELECT session_id, MAX(lap_number) AS n FROM laps WHERE lap_ms IS NOT NULL GROUP BY 1) m ON m.session_id = l.session_id WHERE lap_ms IS NOT NULL AND position IS NOT NULL),
ids AS (SELECT driver_id, CAST(ROW_NUMBER() OVER (ORDER BY driver_id) - 1 AS INT) AS driver_code FROM (SELECT DISTINCT driver_id FROM laps)),
run AS (SELECT *, SUM(lap_ms) OVER (PARTITION BY session_id, driver_id ORDER BY lap_number) AS run FROM timed JOIN ids USING (driver_id)),
near AS (SELECT r.*, LEAST(GREATEST(COALESCE(r.run - a.run, 120000), 0), 120000) / 1000.0 AS ahead, LEAST(GREATEST(COALESCE(b.run - r.run, 120000), 0), 120000) / 1000.0 AS behind
  FROM run r LEFT JOIN run a ON a.session_id = r.session_id AND a.lap_number = r.lap_number AND a.position = r.position - 1
  LEFT JOIN run b ON b.session_id = r.session_id AND b.lap_number = r.lap_number AND b.position = r.position + 1)
"""


@query("h04_pit_training_frame", PIT_FRAME_SQL + RATES_SQL + f"""
, coded AS (SELECT *, CASE compound WHEN 'HARD' THEN 0 WHEN 'INTERMEDIATE' THEN 1 WHEN 'SOFT' THEN 3 WHEN 'WET' THEN 4 ELSE 2 END AS code,
  lap_ms / 1000.0 - 3e-2 * (110 - 110 * (1 - lap_number / n)) AS fuel FROM near),
ages AS (SELECT session_id, driver_id, lap_number, off, {tyre_sql('code', 'tyre_age_laps + off', 'lap_number + off', 'fuel')} AS p FROM (SELECT *, UNNEST(range(0, 40)) AS off FROM coded)),
lives AS (SELECT session_id, driver_id, lap_number, CAST(COALESCE(MIN(CASE WHEN p >= 1.5 THEN off END), 40) AS INT) AS life FROM ages GROUP BY 1, 2, 3),
first_stint AS (SELECT *, MIN(stint_number) OVER (PARTITION BY session_id, driver_id) AS f FROM stints)
SELECT c.session_id, c.driver_id, c.lap_number, tyre_age_laps AS current_tyre_age, life AS predicted_life_remaining, ROUND(ahead, 6) AS gap_to_car_ahead, ROUND(behind, 6) AS gap_to_car_behind,
  n - c.lap_number AS laps_to_race_end, position, ROUND(GREATEST(110 * (1 - c.lap_number / n), 0), 6) AS fuel_load_est,
  ROUND(1 - EXP(-COALESCE((SELECT MAX(rate) FROM rates r WHERE r.circuit_name = c.circuit_name), (SELECT MAX(rate) FROM rates WHERE circuit_name IS NULL))
    * CASE WHEN c.lap_number = 1 THEN 2.5e0 ELSE 1e0 END * CASE WHEN compound IN ('INTERMEDIATE', 'WET') THEN 3e0 ELSE 1e0 END * CASE WHEN c.circuit_name = 'Circuit de Monaco' THEN 1.8e0 ELSE 1e0 END), 6) AS safety_car_probability,
  EXISTS (SELECT 1 FROM first_stint s WHERE s.session_id = c.session_id AND s.driver_id = c.driver_id AND s.start_lap = c.lap_number AND stint_number > f) AS did_pit_this_lap
FROM coded c JOIN lives USING (session_id, driver_id, lap_number)
""")
def h04(spark, root):
    rows = pit_frame(spark, root)
    names = ("gap_to_car_ahead", "gap_to_car_behind", "fuel_load_est", "safety_car_probability")
    return rows.withColumns({n: F.round(n, 6) for n in names})


@query("h02_pit_model", PIT_FRAME_SQL + """
, first_stint AS (SELECT *, MIN(stint_number) OVER (PARTITION BY session_id, driver_id) AS f FROM stints)
SELECT session_id, driver_id, lap_number, TRUE AS is_chance, TRUE AS higher_at_stops,
  EXISTS (SELECT 1 FROM first_stint s WHERE s.session_id = c.session_id AND s.driver_id = c.driver_id AND s.start_lap = c.lap_number AND stint_number > f) AS did_pit_this_lap
FROM near c
""")
def h02(spark, root):
    """Label of every training row; its pit probability is a chance, and on average higher at stops."""
    frame = pit_frame(spark, root)
    model = pits.fit_pit_model(frame)
    scored = tyres.positive_score(model.model)(frame.select(*DRIVER, "lap_number", "did_pit_this_lap", *fixed.PIT_FEATURES))
    means = scored.groupBy("did_pit_this_lap").agg(F.avg("prediction").alias("p"))
    higher = means.agg(F.max(F.when(F.col("did_pit_this_lap"), F.col("p"))) > F.max(F.when(~F.col("did_pit_this_lap"), F.col("p")))).first()[0]
    return scored.select(
        *DRIVER, "lap_number", F.col("prediction").between(0, 1).alias("is_chance"), F.lit(higher).alias("higher_at_stops"), "did_pit_this_lap"
    )


@query("h09_tree_contributions", STATE_SQL + """
, f AS (SELECT session_id, driver_id, CASE WHEN tyre_age_laps < 5 THEN 0e0 ELSE 1.6875 END AS by_age,
  6e-1 * CASE WHEN lap_number < 20 THEN -5e-1 ELSE 2.5e-1 END + 4e-1 * CASE WHEN lap_number < 10 THEN 7.5e-1 ELSE 2e0 END AS by_lap,
  CASE WHEN tyre_age_laps < 5 THEN CASE WHEN lap_number < 20 THEN -5e-1 ELSE 2.5e-1 END ELSE CASE WHEN lap_number < 10 THEN 7.5e-1 ELSE 2e0 END END AS whole FROM state)
SELECT session_id, driver_id, 2.175e0 AS base, ROUND(1.5 + whole, 8) AS prediction, ROUND((by_age - 6.75e-1 + whole - by_lap) / 2, 8) AS of_age, ROUND((by_lap - 6.75e-1 + whole - by_age) / 2, 8) AS of_lap
FROM f
""")
def h09_trees(spark, root):
    """Shapley values of every driver's state under one given tree over age and lap."""
    lap, age = (fixed.TYRE_FEATURES.index(f) for f in ("lap_number", "tyre_age_laps"))
    tree = ("given", -1, 0, [age, lap, lap], [5.0, 20.0, 10.0], [10.0, 6.0, 4.0, 2.0, 4.0, 1.0, 3.0], [-0.5, 0.25, 0.75, 2.0], 1.5)
    forest = boosting.Forest.of(spark.createDataFrame([tree], boosting.TREES), fixed.TYRE_FEATURES)
    rows = state(spark, root).select(
        *DRIVER, *[F.col(f) if f in ("lap_number", "tyre_age_laps") else F.lit(0).alias(f) for f in fixed.TYRE_FEATURES]
    )
    out = explain.tree_contributions(rows, DRIVER, forest, top=len(fixed.TYRE_FEATURES))
    of = lambda f: F.round(F.get(F.filter("contributions", lambda e: e["feature"] == f), F.lit(0))["contribution"], 8)
    return out.select(
        *DRIVER, F.round("base", 8).alias("base"), F.round("prediction", 8).alias("prediction"), of("tyre_age_laps").alias("of_age"), of("lap_number").alias("of_lap")
    )


@query("h05_promote", """
, c AS (SELECT o_orderkey AS name, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END AS holdout, o_totalprice / 2 AS cv FROM orders),
cur AS (SELECT o_orderkey AS name, o_totalprice * CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 2 END AS mae FROM orders WHERE o_orderkey % 3 <> 0)
SELECT CAST(c.name AS VARCHAR) AS model_name, CASE WHEN holdout IS NULL THEN 'cv_only' ELSE 'holdout' END AS promotion_basis, COALESCE(mae IS NULL OR COALESCE(holdout, cv) < mae, FALSE) AS promoted FROM c LEFT JOIN cur ON cur.name = c.name
""")
def h05(spark, root):
    orders = v.read(spark, root, "orders")
    name = F.col("o_orderkey").cast("string").alias("model_name")
    held = orders.filter("o_orderkey % 3 <> 0").select(
        name, F.lit("1").alias("version"),
        (F.col("o_totalprice") * F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(2)).alias("holdout_mae"),
        F.lit(None).cast("double").alias("cv_mae"), F.lit(True).alias("promoted"),
    )
    fresh = orders.select(
        name, F.lit("2").alias("version"), F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("holdout_mae"),
        (F.col("o_totalprice") / 2).alias("cv_mae"),
    )
    return registry.promote(held, fresh).select("model_name", "promotion_basis", "promoted")


_AXES = range(4)
_DIST = " + ".join(f"(r.z{i} - c.z{i}) * (r.z{i} - c.z{i})" for i in _AXES)
_Z = ", ".join(f"z{i}" for i in _AXES)

#: Scaled features, farthest-first starts, and k-means steps as one recursion.
CLUSTER_SQL = STYLE_SQL + f"""
, kept AS MATERIALIZED (SELECT driver_id, season, {", ".join(f"{f} AS f{i}" for i, f in enumerate(fixed.STYLE_FEATURES))}
  FROM sector_var JOIN tyres USING (driver_id, season) JOIN consistency USING (driver_id, season) JOIN lens USING (driver_id, season)
  WHERE {" AND ".join(f"{f} IS NOT NULL" for f in fixed.STYLE_FEATURES)}),
facts AS MATERIALIZED (SELECT {", ".join(f"AVG(f{i}) AS m{i}, STDDEV_SAMP(f{i}) AS d{i}" for i in _AXES)} FROM kept),
scaled AS MATERIALIZED (SELECT driver_id, season, {", ".join(f"CASE WHEN d{i} > 0 THEN (f{i} - m{i}) / d{i} ELSE 0 END AS z{i}" for i in _AXES)} FROM kept CROSS JOIN facts),
start0 AS MATERIALIZED (SELECT 0 AS cluster, {_Z} FROM scaled ORDER BY ROUND({" + ".join(f"z{i} * z{i}" for i in _AXES)}, 9) DESC, driver_id, season LIMIT 1),
""" + "".join(
    f"""start{k} AS MATERIALIZED (SELECT * FROM start{k - 1} UNION ALL (SELECT {k} AS cluster, {_Z} FROM (
  SELECT r.driver_id, r.season, {", ".join(f"r.z{i}" for i in _AXES)}, MIN(ROUND({_DIST}, 9)) AS near FROM scaled r CROSS JOIN start{k - 1} c GROUP BY ALL) WHERE near > 0 ORDER BY near DESC, driver_id, season LIMIT 1)),
"""
    for k in range(1, styles.CLUSTERS)
) + f"""centres AS MATERIALIZED (WITH RECURSIVE lloyd AS (
  SELECT 0 AS step, cluster, {_Z} FROM start{styles.CLUSTERS - 1}
  UNION ALL SELECT step + 1, cluster, {", ".join(f"AVG(z{i})" for i in _AXES)} FROM (
    SELECT c.step, c.cluster, {", ".join(f"r.z{i}" for i in _AXES)}, ROW_NUMBER() OVER (PARTITION BY r.driver_id, r.season ORDER BY ROUND({_DIST}, 9), c.cluster) AS place FROM scaled r CROSS JOIN lloyd c WHERE c.step < {styles.ITERATIONS})
  WHERE place = 1 GROUP BY step, cluster)
  SELECT cluster, {_Z} FROM lloyd WHERE step = {styles.ITERATIONS}),
technical AS (SELECT cluster FROM centres ORDER BY -z0 DESC, cluster LIMIT 1),
inconsistent AS (SELECT cluster FROM centres WHERE cluster NOT IN (FROM technical) ORDER BY z2 + z0 DESC, cluster LIMIT 1),
aggressive AS (SELECT cluster FROM centres WHERE cluster NOT IN (FROM technical UNION ALL FROM inconsistent) ORDER BY z1 DESC, cluster LIMIT 1),
conservative AS (SELECT cluster FROM centres WHERE cluster NOT IN (FROM technical UNION ALL FROM inconsistent UNION ALL FROM aggressive) ORDER BY -z1 DESC, cluster LIMIT 1),
assigned AS MATERIALIZED (SELECT driver_id, season, CAST(cluster AS INT) AS cluster, CASE WHEN cluster IN (FROM technical) THEN 'technical' WHEN cluster IN (FROM inconsistent) THEN 'inconsistent'
  WHEN cluster IN (FROM aggressive) THEN 'aggressive' WHEN cluster IN (FROM conservative) THEN 'conservative' ELSE 'balanced' END AS archetype
  FROM (SELECT r.driver_id, r.season, c.cluster, ROW_NUMBER() OVER (PARTITION BY r.driver_id, r.season ORDER BY ROUND({_DIST}, 9), c.cluster) AS place FROM scaled r CROSS JOIN centres c) WHERE place = 1)
"""


def _m(i: int, j: int) -> str:
    return f"m{min(i, j)}{max(i, j)}"


def _axis_sql(name: str, matrix: str) -> str:
    """The main axis of a symmetric 4 x 4 matrix: its power of 2^24 by squaring, each over its trace."""
    pairs = [(i, j) for i in _AXES for j in range(i, 4)]
    squares = " + ".join(f"{_m(i, j)} * {_m(i, j)}" for i in _AXES for j in _AXES)
    step = ", ".join("(" + " + ".join(f"{_m(i, k)} * {_m(k, j)}" for k in _AXES) + f") / ({squares}) AS {_m(i, j)}" for i, j in pairs)
    columns = ", ".join(_m(i, j) for i, j in pairs)
    picked = " UNION ALL ".join(f"SELECT {_m(j, j)} AS size, {', '.join(f'{_m(i, j)} AS v{i}' for i in _AXES)} FROM grown" for j in _AXES)
    largest = "GREATEST(" + ", ".join(f"ROUND(ABS(v{i}), 9)" for i in _AXES) + ")"
    sign = "SIGN(CASE " + " ".join(f"WHEN ROUND(ABS(v{i}), 9) = {largest} THEN v{i}" for i in _AXES) + " END)"
    unit = f"{sign} / SQRT({' + '.join(f'v{i} * v{i}' for i in _AXES)})"
    return f"""{name} AS MATERIALIZED (WITH RECURSIVE powers AS (SELECT 0 AS step, {columns} FROM {matrix} UNION ALL SELECT step + 1, {step} FROM powers WHERE step < 24),
  grown AS (SELECT * FROM powers WHERE step = 24) SELECT {", ".join(f"v{i} * {unit} AS v{i}" for i in _AXES)} FROM ({picked}) ORDER BY size DESC LIMIT 1)"""


_LAMBDA = " + ".join(f"v{i} * v{j} * {_m(i, j)}" for i in _AXES for j in _AXES)
COORDINATES_SQL = CLUSTER_SQL + f"""
, spread AS MATERIALIZED (SELECT {", ".join(f"COVAR_SAMP(z{i}, z{j}) AS {_m(i, j)}" for i in _AXES for j in range(i, 4))} FROM scaled),
{_axis_sql("axis_x", "spread")},
rest AS MATERIALIZED (SELECT {", ".join(f"{_m(i, j)} - ({_LAMBDA}) * v{i} * v{j} AS {_m(i, j)}" for i in _AXES for j in range(i, 4))} FROM spread CROSS JOIN axis_x),
{_axis_sql("axis_y", "rest")}
SELECT driver_id, season, ROUND({" + ".join(f"z{i} * x.v{i}" for i in _AXES)}, 4) + 0 AS style_x, ROUND({" + ".join(f"z{i} * y.v{i}" for i in _AXES)}, 4) + 0 AS style_y
FROM scaled CROSS JOIN axis_x x CROSS JOIN axis_y y
"""


def _styles(spark, root) -> tuple[styles.StyleModel, DataFrame]:
    features = agg.style_features(season_laps(spark, root), season_stints(spark, root))
    model = styles.fit_styles(features)
    return model, styles.style_assignments(model, features)


@query("h06_driver_styles", CLUSTER_SQL + "SELECT driver_id, season, cluster, archetype FROM assigned")
def h06(spark, root):
    """Cluster and archetype of every driver and season."""
    return _styles(spark, root)[1].select("driver_id", "season", "cluster", "archetype")


@query("h07_archetypes", CLUSTER_SQL + f"""
SELECT CAST(c.cluster AS INT) AS cluster, MIN(archetype) AS archetype, COUNT(*) AS rows, {", ".join(f"ROUND(MIN(z{i}), 8) AS {f}" for i, f in enumerate(fixed.STYLE_FEATURES))}
FROM centres c JOIN assigned a ON a.cluster = c.cluster GROUP BY 1
""")
def h07(spark, root):
    """Name, rows and scaled centre of every cluster."""
    return rounded(styles.archetype_table(*_styles(spark, root)), *fixed.STYLE_FEATURES)


@query("h08_style_coordinates", COORDINATES_SQL)
def h08(spark, root):
    """Coordinates of every driver and season on the two principal axes."""
    rows = _styles(spark, root)[1]
    return rows.select("driver_id", "season", *[(F.round(c, 4) + 0).alias(c) for c in ("style_x", "style_y")])


@query("h09_contributions", STATE_SQL + f"""
, f AS (SELECT session_id, driver_id, circuit_code, driver_code, code, tyre_age_laps AS age, lap_number AS lap, {fuel_sql('lap_number', 'total_laps')} AS fuel FROM state),
parts AS (SELECT session_id, driver_id, UNNEST(['lap_number', 'compound_encoded', 'tyre_age_laps', 'fuel_adjusted_time']) AS feature,
  UNNEST([-1e-3 * (lap - 10), 2e-2 * (code - 2), 6e-2 * (age - 3), 1e-2 * (fuel + 1e0)]) AS c, UNNEST([0, 1, 2, 3]) AS i FROM f),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, driver_id ORDER BY ROUND(ABS(c), 9) DESC, i) AS r FROM parts)
SELECT session_id, driver_id, ROUND(MAX(CASE WHEN r = 1 THEN ABS(c) END), 8) AS top_size, ROUND(SUM(c), 8) AS total FROM r GROUP BY 1, 2
""")
def h09(spark, root):
    """Contributions against fixed means, the ids left at their own value."""
    rows = state(spark, root).select(
        *DRIVER, "lap_number", F.expr("CASE compound WHEN 'HARD' THEN 0 WHEN 'INTERMEDIATE' THEN 1 WHEN 'SOFT' THEN 3 WHEN 'WET' THEN 4 ELSE 2 END").alias("compound_encoded"),
        "tyre_age_laps", scoring.forward_fuel("lap_number", "total_laps").alias("fuel_adjusted_time"),
        F.lit(0).alias("circuit_id_encoded"), F.lit(0).alias("driver_id_encoded"),
    )
    means = {"lap_number": 10, "compound_encoded": 2, "tyre_age_laps": 3, "fuel_adjusted_time": -1, "circuit_id_encoded": 0, "driver_id_encoded": 0}
    out = explain.contributions(rows, DRIVER, fixed.TYRE_FEATURES, means, tyre_score, top=6)
    return out.select(
        *DRIVER, F.round(F.abs(F.get("contributions", F.lit(0))["contribution"]), 8).alias("top_size"),
        F.round(F.aggregate("contributions", F.lit(0.0), lambda a, e: a + e["contribution"]), 8).alias("total"),
    )


@query("h09_explained_windows")
def h09_windows(spark, root):
    """Pit windows from fitted models, the best one explained."""
    models, _, _ = _tyres(spark, root)
    held = state(spark, root)
    score = models.score()
    rows = explain.explain_top_window(pitstops.pit_windows(held, score), held, models.forest)
    return rows.select(*DRIVER, "pit_lap", F.round("projected_total_delta_seconds", 6).alias("total"), F.size(F.coalesce("contributions", F.array().cast(rows.schema["contributions"].dataType))).alias("reasons"))


SCORED_SQL = GAPPED_SQL.replace("gapped AS (SELECT *,", "gapped AS (SELECT *, LEAST(GREATEST(COALESCE((LEAD(elapsed) OVER (PARTITION BY session_id ORDER BY position, driver_id)) - elapsed, 120), 0), 120)::DOUBLE AS behind,") + f"""
, scored AS (SELECT s.*, COALESCE(g.gap, 120) AS gap, COALESCE(g.position, k.n + 1) AS place, {tyre_sql('s.code', 's.tyre_age_laps', 's.lap_number', fuel_sql('s.lap_number', 's.total_laps')).replace('circuit_code', 's.circuit_code').replace('driver_code', 's.driver_code')} AS delta
  FROM state s LEFT JOIN gapped g ON g.session_id = s.session_id AND g.driver_id = s.driver_id JOIN (SELECT session_id, COUNT(*) AS n FROM last GROUP BY 1) k ON k.session_id = s.session_id),
ages AS (SELECT session_id, driver_id, off, {tyre_sql('code', 'tyre_age_laps + off', 'lap_number + off', fuel_sql('lap_number', 'total_laps'))} AS p FROM (SELECT *, UNNEST(range(0, 40)) AS off FROM scored)),
lives AS (SELECT session_id, driver_id, CAST(COALESCE(MIN(CASE WHEN p >= 1.5 THEN off END), 40) AS INT) AS life FROM ages GROUP BY 1, 2),
predicted AS (SELECT session_id, driver_id, lap_number, CAST(lap_number + GREATEST(CAST(TRUNC(delta) AS INT), 1) AS INT) AS optimal_pit_lap, ROUND(delta, 8) AS tire_life_remaining, life AS life_laps,
  ROUND({pit_sql('tyre_age_laps', 'life', 'gap', '1 - EXP(-1e-2)', 'total_laps - lap_number', 'place')}, 8) AS pit_probability, 0e0 AS confidence_score FROM scored JOIN lives USING (session_id, driver_id))
"""


@query("h10_score_laps", SCORED_SQL + "SELECT * FROM predicted")
def h10(spark, root):
    """Latest lap of every driver scored with the linear formulas and one fixed rate."""
    held = v.laps(spark, root).withColumn("lap_time_seconds", F.col("lap_ms") / 1000.0)
    now = state(spark, root).withColumn("circuit_name", F.lit("Test"))
    batch = now.select(*DRIVER, "lap_number", F.when(F.col("compound") == "never", "x").otherwise(F.lower("compound")).alias("compound"), "tyre_age_laps")
    rates = v.context(spark, root).agg(F.lit(None).cast("string").alias("circuit_name"), F.lit(0.01).alias("rate"))
    dry = batch.withColumn("compound", F.col("compound"))
    rows = scoring.score_laps(dry, held, now, rates, tyre_score, _flat_sc(pit_score))
    return rounded(rows, "tire_life_remaining", "pit_probability").select(
        *DRIVER, "lap_number", "optimal_pit_lap", "tire_life_remaining", "life_laps", "pit_probability", "confidence_score"
    )


def _flat_sc(score):
    """Pit score at a fixed safety-car chance, so wet compounds do not change it."""
    return lambda df: score(df.withColumn("safety_car_probability", 1 - F.exp(F.lit(-0.01))))


@query("h10_undercut_scores", GAPPED_SQL + "SELECT session_id, driver_id FROM state")
def h10_drivers(spark, root):
    """Every driver gets a prediction row, with or without neighbours."""
    held = v.laps(spark, root).withColumn("lap_time_seconds", F.col("lap_ms") / 1000.0)
    now = state(spark, root).withColumn("circuit_name", F.lit("Test"))
    rates = v.context(spark, root).agg(F.lit(None).cast("string").alias("circuit_name"), F.lit(0.01).alias("rate"))
    rows = scoring.score_laps(now, held, now, rates, tyre_score, pit_score)
    inside = F.col("undercut_score").between(0, 1) & F.col("overcut_score").between(0, 1)
    return rows.filter(inside).select(*DRIVER)
