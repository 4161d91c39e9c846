"""Tyre-degradation models, one per compound, and scoring with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock import fixed
from paddock.functions.scalars import compound_code, compound_model, fuel_features
from paddock.ml import boosting
from paddock.ml.boosting import BoostParams, Forest
from paddock.operators.aggregates import laps_in_session
from paddock.operators.encode import apply_codes, model_folds
from paddock.operators.windows import impute_weather, lap_time_delta
from paddock.plans.projection import Score
from paddock.scratch import materialise


@dataclass(frozen=True)
class TyreModel:
    rows: int
    cv_mae: float | None
    cv_rmse: float | None
    holdout_mae: float | None = None


@dataclass(frozen=True)
class TyreModels:
    """Trees of all compounds, errors by model name."""

    trees: DataFrame
    forest: Forest
    by_name: dict[str, TyreModel]

    def score(self) -> Score:
        """Score function that sends each row to its compound's model."""
        return model_score(self.forest)

    def table(self, name: str) -> DataFrame:
        """Rows of one compound's trees, as a model store keeps them."""
        return self.trees.where((F.col("model") == name) & (F.col("held") == boosting.ALL))


def tyre_features(laps: DataFrame, codes: Mapping[str, DataFrame]) -> DataFrame:
    """Training frame: valid timed laps with encodings, fuel, delta and imputed weather.

    ``laps`` has circuit_id; ``codes`` holds the code tables of circuit_id and driver_id.
    Each compound has a model of its own, so medians are over the compound's laps.  Build
    the frames of training and holdout laps separately: imputed means must not mix.
    """
    valid = laps.filter(F.col("is_valid") & F.col("lap_time_seconds").isNotNull())
    fuelled = fuel_features(laps_in_session(valid))
    deltas = lap_time_delta(fuelled, keys=("session_id", "driver_id", "compound"))
    coded = apply_codes(impute_weather(deltas), dict(codes))
    return coded.withColumns(
        {"compound_encoded": compound_code("compound"), "tyre_model": compound_model("compound")}
    )


def fit_tyre_models(
    train: DataFrame, holdout: DataFrame | None = None, params: BoostParams = BoostParams(), cv: bool = True
) -> TyreModels:
    """One model per compound with rows, all grown together; folds never share a session.

    ``train`` and ``holdout`` come from ``tyre_features``.
    """
    cols = ["session_id", F.col("tyre_model").alias("model"), *fixed.TYRE_FEATURES, F.col("lap_time_delta").alias("target")]
    kept = materialise(train.where("lap_time_delta is not null").select(*cols), "tyre-features")
    rows = materialise(model_folds(kept, "model", "session_id", params.folds), "tyre-folds") if cv else kept.withColumn("fold", F.lit(boosting.ALL))
    trees = boosting.fit(rows, fixed.TYRE_FEATURES, params)
    forest = Forest.of(trees, fixed.TYRE_FEATURES)
    counts = {r["model"]: r["count"] for r in rows.groupBy("model").count().collect()}
    crossed, held_out = {}, {}
    if cv:
        crossed = {r["model"]: r for r in _fold_errors(forest.score(rows, "model", "fold")).collect()}
    if holdout is not None:
        held_out = {r["model"]: r["mae"] for r in _errors(forest.score(holdout.select(*cols), "model"), ["model"]).collect()}
    by_name = {}
    for name in (n for n in fixed.COMPOUND_MODELS.values() if n in counts):
        errors = crossed.get(name)
        mae, rmse = (errors["mae"], errors["rmse"]) if errors else (None, None)
        by_name[name] = TyreModel(counts[name], mae, rmse, held_out.get(name))
    return TyreModels(trees, forest, by_name)


def _errors(scored: DataFrame, by: list[str]) -> DataFrame:
    error = F.col("prediction") - F.col("target")
    return scored.groupBy(*by).agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))


def _fold_errors(scored: DataFrame) -> DataFrame:
    """Errors per fold, averaged over the folds of models that have two or more."""
    per = _errors(scored, ["model", "fold"]).groupBy("model").agg(
        F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.count("*").alias("folds")
    )
    return per.where("folds > 1")


@dataclass(frozen=True)
class ForestScore:
    """Scores rows by ``tyre_model``; rows whose model is missing get ``default``."""

    forest: Forest
    default: float = 0.0

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.forest.score(df, "tyre_model", default=self.default)

    def stints(self, df: DataFrame, keys: Sequence[str], summed: Column) -> DataFrame:
        """As ``projection.score_stints``, with the laps of a ``summed`` stint as one row of their sum.

        Laps are made, scored and summed in the task, at most ``SCORE_ROWS`` at once.
        """
        models, default, keys, most = df.sparkSession.sparkContext.broadcast(self.forest), float(self.default), list(keys), boosting.SCORE_ROWS
        numbers = ("start_lap", "start_age", "total_laps", "circuit_code", "driver_code")
        rows = df.select(
            *keys, *numbers, F.greatest("n_laps", F.lit(1)).cast("bigint").alias("_n"), F.coalesce(F.col("n_laps") > 0, F.lit(False)).alias("_run"),
            compound_code("compound").alias("_code"), compound_model("compound").alias("_model"), F.coalesce(summed, F.lit(False)).alias("_summed"),
        )
        schema = rows.select(*keys, F.lit(0).alias("lap_number"), F.lit(0.0).alias("delta")).schema
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

        def laps(batch, at, i, code, names):
            """Predicted deltas of the given laps of a batch's stints, and their lap numbers."""
            forest = models.value
            x = boosting.feature_matrix(batch, [*numbers, "_code"])[at]
            lap, total = x[:, 0] + i, np.fmax(x[:, 2], 1.0)
            fuel = -fixed.FUEL_SECONDS_PER_KG * (fixed.START_FUEL_KG - fixed.START_FUEL_KG * (1 - lap / total))
            of = {"lap_number": lap, "compound_encoded": x[:, 5], "tyre_age_laps": x[:, 1] + i, "fuel_adjusted_time": fuel, "circuit_id_encoded": x[:, 3], "driver_id_encoded": x[:, 4]}
            x = np.stack([of[f] for f in forest.features], 1)
            delta = np.full(len(at), default)
            for k, name in enumerate(names):
                if (name, boosting.ALL) in forest.models and len(those := np.flatnonzero(code[at] == k)):
                    delta[those] = forest.predict(x[those], name)
            return delta, lap

        def score(batches):
            for batch in batches:
                column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
                n, run, whole = (column(c).to_numpy(zero_copy_only=False) for c in ("_n", "_run", "_summed"))
                names, code = boosting.name_codes(pa.chunked_array([column("_model")]))
                ends = np.cumsum(n)
                begins, sums = ends - n, np.zeros(len(n))
                for a in range(0, int(ends[-1]) if len(n) else 0, most):
                    flat = np.arange(a, min(a + most, int(ends[-1])))
                    at = np.searchsorted(ends, flat, "right")
                    delta, lap = laps(batch, at, flat - begins[at], code, names)
                    delta = np.where(run[at], delta, 0.0)
                    sums[at[0] : at[-1] + 1] += np.bincount(at - at[0], delta)
                    single = np.flatnonzero(~whole[at])
                    if len(single):
                        yield made(batch, at[single], lap[single], delta[single])
                those = np.flatnonzero(whole)
                if len(those):
                    yield made(batch, those, np.full(len(those), np.nan), sums[those])

        def made(batch, at, lap, delta):
            number = pa.array(np.nan_to_num(lap).astype(np.int32), pa.int32(), mask=np.isnan(lap))
            kept = [batch.column(batch.schema.get_field_index(k)).take(pa.array(at)) for k in keys]
            return pa.RecordBatch.from_arrays([*kept, number, pa.array(delta)], [*keys, "lap_number", "delta"])

        return rows.mapInArrow(score, schema)


def model_score(forest: Forest, default: float = 0.0) -> Score:
    """Score rows by ``tyre_model``; rows whose model is missing get ``default``."""
    return ForestScore(forest, default)


def positive_score(forest: Forest) -> Score:
    """Score function giving the chance of a positive row."""
    return forest.probability
