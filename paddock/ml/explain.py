"""Feature contributions: exact Shapley values under trees, or one feature replaced by its training mean for any score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock import fixed
from paddock.functions.scalars import compound_code, compound_model, forward_fuel
from paddock.ml.boosting import Forest, feature_matrix, together
from paddock.operators.aggregates import DRIVER
from paddock.operators.reshape import top_contributions, top_k
from paddock.plans.projection import Score
from paddock.scratch import materialise


def contributions(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], means: Mapping[str, float], score: Score,
    top: int = 5,
) -> DataFrame:
    """Per row the ``top`` features whose replacement changes the prediction most.

    Every row is scored once as it is and once per feature, in one scoring pass.
    """
    features = list(features)
    routed = [c for c in ("tyre_model",) if c in df.columns]
    variants = df.select(
        F.struct(*keys).alias("_key"), F.struct(*features).alias("_now"), *routed,
        F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))).alias("_swap"),
    )
    rows = variants.select(
        "_key", "_now", "_swap", *routed,
        *[
            F.when(F.col("_swap") == i, F.lit(float(means[f]))).otherwise(F.col(f"_now.{f}").cast("double")).alias(f)
            for i, f in enumerate(features)
        ],
    )
    scored = score(rows)
    base = F.max(F.when(F.col("_swap") == -1, F.col("prediction")))
    swapped = [F.max(F.when(F.col("_swap") == i, F.col("prediction"))) for i in range(len(features))]
    each = scored.groupBy("_key").agg(
        base.alias("prediction"), F.first("_now").alias("_now"), *[s.alias(f"_s{i}") for i, s in enumerate(swapped)]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"), F.col(f"_now.{f}").cast("double").alias("value"),
                (F.col("prediction") - F.col(f"_s{i}")).alias("contribution"),
            )
            for i, f in enumerate(features)
        ]
    )
    return top_contributions(each.select("_key.*", "prediction", entries.alias("contributions")), top)


def tree_contributions(df: DataFrame, keys: Sequence[str], forest: Forest, route: str | None = None, top: int = 5) -> DataFrame:
    """Per row the ``top`` features by their exact Shapley values under the trees.

    ``base`` is the mean prediction along the covers; base and the values of all features add up to
    ``prediction``.  Rows whose model is missing have neither.
    """
    models = df.sparkSession.sparkContext.broadcast(forest)
    features = list(forest.features)
    kinds = df.select(*keys).schema
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], "prediction double", "base double",
                        "contributions array<struct<feature:string,value:double,contribution:double>>"])

    def explain(batches):
        held = models.value
        kind = pa.list_(pa.struct([("feature", pa.string()), ("value", pa.float64()), ("contribution", pa.float64())]))
        for some in together(batches):
            x = np.concatenate([feature_matrix(b, features) for b in some])
            names = [n for b in some for n in b.column(b.schema.get_field_index(route)).to_pylist()] if route else [held.names()[0]] * len(x)
            names = np.array(names, object)
            there, total, mean, phi = np.zeros(len(x), bool), np.zeros(len(x)), np.zeros(len(x)), np.zeros(x.shape)
            for name in held.names():
                at = np.flatnonzero(names == name)
                if len(at):
                    there[at], total[at] = True, held.predict(x[at], name)
                    mean[at], phi[at] = held.contributions(x[at], name)
            upto = 0
            for batch in some:
                rows: list = [None] * batch.num_rows
                for i in np.flatnonzero(there[upto : upto + batch.num_rows]):
                    k = upto + i
                    given = [None if np.isnan(v) else float(v) for v in x[k]]
                    rows[i] = (float(total[k]), float(mean[k]), [{"feature": f, "value": v, "contribution": float(c)} for f, v, c in zip(features, given, phi[k], strict=True)])
                upto += batch.num_rows
                columns = [pa.array([None if r is None else r[k] for r in rows], t) for k, t in enumerate((pa.float64(), pa.float64(), kind))]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(batch.schema.get_field_index(k)) for k in keys], *columns], [*keys, "prediction", "base", "contributions"]
                )

    asked = df.select(*dict.fromkeys([*keys, *features, *([route] if route else [])]))
    return top_contributions(asked.mapInArrow(explain, schema), top)


def feature_means(train: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Training means, one row."""
    row = train.agg(*[F.avg(f).alias(f) for f in features]).first()
    return {f: float(row[f] or 0.0) for f in features}


def explain_top_window(
    windows: DataFrame, state: DataFrame, forest: Forest, top: int = 5
) -> DataFrame:
    """Pit windows where the best candidate of each driver carries contributions."""
    windows = materialise(windows, "windows")
    best = top_k(windows, DRIVER, [F.round("projected_total_delta_seconds", 9), F.col("pit_lap")], 1)
    rows = best.select(*DRIVER, "pit_lap").join(state, list(DRIVER)).select(
        *DRIVER, "pit_lap",
        F.col("pit_lap").alias("lap_number"),
        compound_code("compound").alias("compound_encoded"),
        (F.col("tyre_age_laps") + F.col("pit_lap") - F.col("lap_number")).alias("tyre_age_laps"),
        forward_fuel("pit_lap", "total_laps").alias("fuel_adjusted_time"),
        F.col("circuit_code").alias("circuit_id_encoded"),
        F.col("driver_code").alias("driver_id_encoded"),
        compound_model("compound").alias("tyre_model"),
    )
    why = tree_contributions(rows, [*DRIVER, "pit_lap"], forest, "tyre_model", top).drop("prediction", "base")
    return windows.join(why, [*DRIVER, "pit_lap"], "left")
