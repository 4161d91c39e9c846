"""Model mechanics on small synthetic laps."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from paddock import fixed
from paddock.ml import boosting, explain, pits, registry, styles, training, tyres
from paddock.ml.boosting import Forest
from paddock.operators import aggregates as agg
from paddock.operators import encode
from paddock.scratch import new_path
from tests.test_golden import style_input

QUICK = tyres.BoostParams(rounds=5, rate=0.3, depth=3, folds=2)


@pytest.fixture(scope="module")
def laps(spark):
    """Two compounds over three sessions: SOFT wears ten times as fast as HARD."""
    data = [
        (f"s{s}", f"d{d}", n, c, (n - 1) % 15, 90.0 + ((n - 1) % 15) * rate + d * 0.05, d + 1)
        for s in range(3) for d, (c, rate) in enumerate((("SOFT", 0.3), ("HARD", 0.03)) * 2) for n in range(1, 46)
    ]
    return spark.createDataFrame(
        data, "session_id string, driver_id string, lap_number int, compound string, tyre_age_laps int, lap_time_seconds double, position int"
    ).withColumns(
        {"is_valid": F.lit(True), "circuit_id": F.lit("c"), "circuit_name": F.lit("Suzuka Circuit"), "track_temp": F.lit(30.0),
         "air_temp": F.lit(None).cast("double"), "track_status": F.lit("1")}
    )


@pytest.fixture(scope="module")
def fitted(laps):
    codes = {c: encode.code_table(laps, c) for c in ("circuit_id", "driver_id")}
    train = tyres.tyre_features(laps, codes)
    return tyres.fit_tyre_models(train, train.filter("session_id = 's2'"), QUICK), train


def test_tyre_models(spark, fitted):
    models, train = fitted
    assert set(models.by_name) == {"soft", "hard"}
    for m in models.by_name.values():
        assert m.rows == 270 and m.cv_mae > 0 and m.cv_rmse >= m.cv_mae and m.holdout_mae is not None
    one = train.select(*[f for f in fixed.TYRE_FEATURES if f not in ("tyre_age_laps", "lap_number")], "tyre_model").dropDuplicates(["tyre_model"])
    at = one.withColumn("tyre_age_laps", F.explode(F.array(F.lit(1), F.lit(14)))).withColumn("lap_number", F.lit(20))
    got = {(r.tyre_model, r.tyre_age_laps): r.prediction for r in models.score()(at).collect()}
    assert got["soft", 14] - got["soft", 1] > got["hard", 14] - got["hard", 1]
    missing = models.score()(at.withColumn("tyre_model", F.lit("wet"))).select("prediction").distinct().collect()
    assert [r[0] for r in missing] == [0.0]


def test_pit_model(spark, laps, fitted):
    models, _ = fitted
    codes = {c: encode.code_table(laps, c) for c in ("circuit_id", "driver_id")}
    stints = agg.build_stints(laps.withColumn("stint_number", F.floor((F.col("lap_number") - 1) / 15).cast("int") + 1))
    rates = spark.createDataFrame([(None, 0.01)], "circuit_name string, rate double")
    frame = pits.pit_training_frame(encode.apply_codes(laps, codes), stints, models.score(), rates)
    held = frame.collect()
    assert len(held) == 540 and sum(r.did_pit_this_lap for r in held) == 24
    assert all(r.laps_to_race_end == 45 - r.lap_number and r.fuel_load_est >= 0 for r in held)
    assert all(0 <= r.predicted_life_remaining <= 40 for r in held)
    model = pits.fit_pit_model(frame, QUICK)
    assert model.rows == 540 and model.positive_rate == pytest.approx(24 / 540) and 0.5 < model.cv_auc <= 1
    scored = tyres.positive_score(model.model)(frame)
    p = {r.label: r.p for r in scored.groupBy(F.col("did_pit_this_lap").alias("label")).agg(F.avg("prediction").alias("p")).collect()}
    assert 0 <= p[False] < p[True] <= 1


def test_archetypes():
    means = {0: [5, 0, 0, 0], 1: [-2, 0, 0, 0], 2: [0, 3, 0, 0], 3: [0, -3, 0, 0], 4: [0, 0, 0, 0]}
    assert styles.label_archetypes(means) == {1: "technical", 0: "inconsistent", 2: "aggressive", 3: "conservative", 4: "balanced"}
    assert styles.label_archetypes({0: [0, 0, 0, 0], 1: [1, 0, 0, 0]}) == {0: "technical", 1: "inconsistent"}


def test_styles(spark):
    features = agg.style_features(*style_input(spark))
    model = styles.fit_styles(features)
    got = styles.style_assignments(model, features).collect()
    assert len(got) == 8 and {r.archetype for r in got} >= {"technical", "aggressive"}
    assert all(r.style_x is not None and r.style_y is not None for r in got)
    with pytest.raises(ValueError):
        styles.fit_styles(features.limit(1))


def test_styles_equal_a_plain_version(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centre = np.array([[0, 0, 0, 0], [9, 0, 0, 1], [0, 8, 1, 0], [0, 0, 9, 9.0]])
    x = centre[rng.integers(0, 4, 60)] + rng.normal(size=(60, 4))
    x[10] = x[11]  # a tie
    rows = spark.createDataFrame(
        [(f"d{i:02}", 2024, *map(float, r)) for i, r in enumerate(x)], ["driver_id", "season", *fixed.STYLE_FEATURES]
    ).repartition(7)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    held = [z[np.argmax((z**2).sum(1))]]
    while len(held) < 5:
        held.append(z[np.argmax(np.round(((z[:, None] - held) ** 2).sum(2), 9).min(1))])
    for _ in range(100):
        of = np.round(((z[:, None] - held) ** 2).sum(2), 9).argmin(1)
        held = [z[of == c].mean(0) for c in range(5)]
    _, axes = np.linalg.eigh(np.cov(z.T))
    model = styles.fit_styles(rows)
    got = sorted(styles.style_assignments(model, rows).collect())
    assert [r.cluster for r in got] == of.tolist()
    for name, axis in (("style_x", axes[:, 3]), ("style_y", axes[:, 2])):
        want = z @ axis * np.sign(axis[np.abs(axis).argmax()])
        assert np.allclose([r[name] for r in got], want)
    table = styles.archetype_table(model, styles.style_assignments(model, rows)).collect()
    assert sum(r["rows"] for r in table) == 60 and {r.archetype for r in table} == {"technical", "inconsistent", "aggressive", "conservative", "balanced"}


def test_styles_of_equal_rows(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 2.0, 3.0, 4.0), ("b", 1, 1.0, 2.0, 3.0, 4.0)], ["driver_id", "season", *fixed.STYLE_FEATURES])
    got = styles.style_assignments(styles.fit_styles(rows), rows).collect()
    assert {(r.cluster, r.archetype, r.style_x, r.style_y) for r in got} == {(0, "technical", 0.0, 0.0)}


def test_promotion(spark):
    have = spark.createDataFrame(
        [("a", "1", 0.9, None, True), ("a", "2", 0.5, None, True), ("a", "3", 0.1, None, False), ("b", "1", None, 0.4, True)],
        "model_name string, version string, holdout_mae double, cv_mae double, promoted boolean",
    )
    new = spark.createDataFrame(
        [("a", "4", 0.5, 0.1), ("b", "4", None, 0.3), ("c", "4", 9.0, None)], "model_name string, version string, holdout_mae double, cv_mae double"
    )
    got = {r.model_name: (r.promotion_basis, r.promoted) for r in registry.promote(have, new).collect()}
    assert got == {"a": ("holdout", False), "b": ("cv_only", True), "c": ("holdout", True)}


def test_model_store(spark):
    store = registry.ModelStore(spark, new_path(spark, "store"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v")]).fit(spark.range(1).withColumn("x", F.lit(1.0)))
    assert store.production("m") is None
    for version, mae in (("20240101-000000", 0.5), ("20240102-000000", 0.7), ("20240103-000000", 0.2)):
        store.publish(version, {"m": (model, mae, None)})
    got = {r.version: r.promoted for r in store.registry().collect()}
    assert got == {"20240101-000000": True, "20240102-000000": False, "20240103-000000": True}
    assert store.production("m") is not None


def test_training_run(spark, laps):
    seasons = laps.withColumn("season", 2023 + F.substring("session_id", 2, 1).cast("int"))
    stints = agg.build_stints(laps.withColumn("stint_number", F.floor((F.col("lap_number") - 1) / 15).cast("int") + 1))
    store = registry.ModelStore(spark, new_path(spark, "run"))
    first = {r.model_name: r for r in training.train_all(seasons, stints, store, "20250101-000000", QUICK, cv=False).collect()}
    assert set(first) == {"tyre_soft", "tyre_hard", "safety_car", "pit"} and all(r.promoted for r in first.values())
    assert all(r.holdout_mae is not None and r.promotion_basis == "holdout" for r in first.values())
    again = training.train_all(seasons, stints, store, "20250102-000000", QUICK, cv=False).collect()
    assert not any(r.promoted for r in again)
    assert Forest.of(store.production_table("tyre_soft"), fixed.TYRE_FEATURES).names() == ["soft"] and store.production_table("safety_car").count() == 2


def test_contributions(spark):
    df = spark.createDataFrame([("r", 3.0, 10.0)], "k string, x double, y double")
    score = lambda d: d.withColumn("prediction", 2 * F.col("x") - F.col("y"))
    r = explain.contributions(df, ["k"], ["x", "y"], {"x": 1.0, "y": 4.0}, score).first()
    assert [(e.feature, e.value, e.contribution, e.direction) for e in r.contributions] == [("y", 10.0, -6.0, "-"), ("x", 3.0, 4.0, "+")]


def test_nearest_places_round_only_what_is_close(spark):
    """Steps of k-means in numpy agree with the column that assigns rows, ties and missing values included."""
    import numpy as np

    centres = {0: (0.0, 0.0, 0.0, 0.0), 2: (1.0, 0.0, 0.0, 0.0), 3: (1.0, 1e-12, 0.0, 0.0)}
    rows = [(0.5, 0.0, 0.0, 0.0), (0.5 + 1e-11, 0.0, 0.0, 0.0), (0.51, 0.0, 0.0, 0.0), (2.0, 3.0, 1.0, 0.0), (None, 0.0, 5.0, 0.0), (-1.0, 2.0, 0.0, 1e6)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, " + ", ".join(f"{z} double" for z in styles._SCALED))
    want = [r[0] for r in df.select("id", styles.nearest(centres).alias("c")).orderBy("id").select("c").collect()]
    z = np.array([[np.nan if v is None else v for v in r] for r in rows])
    got = styles._places(z, ~np.isnan(z).any(1), np.array([centres[c] for c in sorted(centres)]))
    assert [sorted(centres)[k] for k in got] == want
    sums = df.select(*styles._SCALED).mapInArrow(styles._cluster_sums(centres), "cluster int, " + ", ".join(f"s{i} double, n{i} bigint" for i in range(4)))
    assert sorted(sums.groupBy("cluster").agg(F.sum("n0"), F.sum("n1")).collect()) == sorted((c, sum(w == c and r[0] is not None for w, r in zip(want, rows)), want.count(c)) for c in set(want))
