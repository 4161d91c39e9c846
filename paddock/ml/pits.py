"""Pit classifier: training frame, fit and validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock import fixed
from paddock.functions.scalars import compound_code, compound_model, fuel_features
from paddock.ml import boosting
from paddock.ml.boosting import BoostParams, Forest
from paddock.ml.tyres import positive_score
from paddock.operators.aggregates import auc
from paddock.operators.encode import model_folds
from paddock.operators.joins import LAP_KEYS, gap_features, label_pit_laps
from paddock.operators.windows import progress_features
from paddock.plans.projection import Score, life_remaining
from paddock.plans.safetycar import with_next_lap_sc
from paddock.scratch import materialise


@dataclass(frozen=True)
class PitModel:
    trees: DataFrame
    model: Forest
    cv_auc: float | None
    rows: int
    positive_rate: float


def pit_training_frame(laps: DataFrame, stints: DataFrame, score_tyre: Score, rates: DataFrame) -> DataFrame:
    """All timed laps with the eight pit features and the label.

    ``laps`` has season context and the encoded ids.  The race length is that of all timed
    laps; rows without a position drop out after that.
    """
    timed = laps.filter(F.col("lap_time_seconds").isNotNull())
    rows = label_pit_laps(fuel_features(gap_features(progress_features(timed))), stints)
    coded = rows.withColumns(
        {"compound_encoded": compound_code("compound"), "tyre_model": compound_model("compound")}
    )
    held = materialise(with_next_lap_sc(coded, rates), "pit-frame")
    life = life_remaining(held, LAP_KEYS, score_tyre).withColumnRenamed(
        "life_remaining", "predicted_life_remaining"
    )
    return held.join(life, list(LAP_KEYS)).select(
        *LAP_KEYS, *[f for f in fixed.PIT_FEATURES], "did_pit_this_lap"
    )


def fit_pit_model(train: DataFrame, params: BoostParams = BoostParams(), cv: bool = True) -> PitModel:
    """Pit chance of a lap; a pit lap weighs as much as (1 - p) / p others."""
    label = F.col("did_pit_this_lap").cast("double")
    rows = train.select("session_id", F.lit("pit").alias("model"), *fixed.PIT_FEATURES, label.alias("target"))
    rows = materialise(model_folds(rows, "model", "session_id", params.folds) if cv else rows.withColumn("fold", F.lit(boosting.ALL)), "pit-train")
    trees = boosting.fit(rows, fixed.PIT_FEATURES, params, heavy=True)
    forest = Forest.of(trees, fixed.PIT_FEATURES)
    area = None
    if cv and len(forest.models) > 1:
        scored = forest.probability(rows, "model", "fold").select("fold", F.col("target").alias("label"), F.col("prediction").alias("score"))
        area = auc(materialise(scored, "pit-scored")).agg(F.avg("auc")).first()[0]
    facts = rows.agg(F.count("*").alias("n"), F.avg("target").alias("p")).first()
    return PitModel(trees.where(F.col("held") == boosting.ALL), forest, area, facts["n"], facts["p"] or 0.0)


def pit_holdout_mae(forest: Forest, holdout: DataFrame) -> float | None:
    """Mean distance between the pit probability and the label, None without rows."""
    error = F.abs(F.col("prediction") - F.col("did_pit_this_lap").cast("double"))
    return positive_score(forest)(holdout).agg(F.avg(error)).first()[0]
