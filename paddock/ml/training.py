"""One training run: tyre models, safety-car rates, pit model, promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paddock.functions.scalars import season_split
from paddock.ml.pits import fit_pit_model, pit_holdout_mae, pit_training_frame
from paddock.ml.registry import ModelStore
from paddock.ml.tyres import BoostParams, fit_tyre_models, tyre_features
from paddock.operators.aggregates import fit_sc_rates
from paddock.operators.encode import apply_codes, code_table
from paddock.operators.windows import lap_flags
from paddock.plans.safetycar import sc_holdout_mae
from paddock.scratch import materialise

CODED = ("circuit_id", "driver_id")


def train_all(
    laps: DataFrame, stints: DataFrame, store: ModelStore, version: str,
    params: BoostParams = BoostParams(), cv: bool = True,
) -> DataFrame:
    """Fit every model on the training seasons, score the holdout season, publish.

    ``laps`` carries season, circuit_id and circuit_name.  Tyre models and safety-car rates
    see valid laps; the pit model sees all timed laps, because pit laps are often invalid.
    Returns this version's registry rows.  Code tables are saved with the models.
    """
    codes = {c: materialise(code_table(laps, c), "codes") for c in CODED}
    for column, table in codes.items():
        store.save(f"{column}_codes", version, table)
    train, holdout = (materialise(part, "split") for part in season_split(laps))

    tyres = fit_tyre_models(tyre_features(train, codes), tyre_features(holdout, codes), params, cv)
    published = {f"tyre_{n}": (tyres.table(n), m.holdout_mae, m.cv_mae) for n, m in tyres.by_name.items()}

    rates = materialise(fit_sc_rates(lap_flags(train.filter("is_valid"))), "rates")
    sc_error = sc_holdout_mae(lap_flags(holdout.filter("is_valid")), rates)
    published["safety_car"] = (rates, sc_error, None)

    score = tyres.score()
    frames = [
        materialise(pit_training_frame(apply_codes(part, codes), stints, score, rates), "pit-frame")
        for part in (train, holdout)
    ]
    pit = fit_pit_model(frames[0], params, cv)
    published["pit"] = (pit.trees, pit_holdout_mae(pit.model, frames[1]), None)
    return store.publish(version, published)
