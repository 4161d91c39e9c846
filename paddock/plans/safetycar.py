"""Safety-car probability from fitted rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock import fixed


def sc_probability(
    df: DataFrame, rates: DataFrame, horizons: Sequence[int] = fixed.SC_HORIZONS
) -> DataFrame:
    """One row per input row and horizon with the chance of at least one event.

    ``rates`` is the output of ``fit_sc_rates``: its NULL circuit is the default rate.
    """
    rated = with_sc_rate(df, rates)
    rows = rated.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return rows.withColumn(
        "safety_car_probability", 1 - F.exp(-F.col("_lambda") * F.col("horizon"))
    ).drop("_lambda")


def with_next_lap_sc(df: DataFrame, rates: DataFrame) -> DataFrame:
    """Chance of an event on the next lap, as a model feature."""
    return with_sc_rate(df, rates).withColumn(
        "safety_car_probability", 1 - F.exp(-F.col("_lambda"))
    ).drop("_lambda")


def with_sc_rate(df: DataFrame, rates: DataFrame) -> DataFrame:
    """Fitted rate of each row's circuit (else the default) times its factors, as ``_lambda``.

    The rates, one row per circuit, are read once, as one value.
    """
    known = F.col("circuit_name").isNotNull()
    entry = F.when(known, F.struct("circuit_name", "rate"))
    held = rates.agg(
        F.struct(F.max(F.when(~known, F.col("rate"))).alias("default"), F.map_from_entries(F.collect_list(entry)).alias("per"))
    ).scalar()
    base = F.coalesce(F.try_element_at(F.col("_rates.per"), F.col("circuit_name")), F.col("_rates.default"), F.lit(0.0))
    factor = (
        F.when(F.col("lap_number") == 1, fixed.SC_LAP1).otherwise(1.0)
        * F.when(F.col("compound").isin(*fixed.WET_COMPOUNDS), fixed.SC_WET).otherwise(1.0)
        * F.when(F.col("circuit_name").isin(*fixed.STREET_CIRCUITS), fixed.SC_STREET).otherwise(1.0)
    )
    return df.withColumn("_rates", held).withColumn("_lambda", base * factor).drop("_rates")


def sc_holdout_mae(flags: DataFrame, rates: DataFrame) -> float | None:
    """Mean distance between the next-lap chance and the onset flag, None without rows."""
    error = F.abs(F.col("safety_car_probability") - F.col("is_sc_event").cast("double"))
    return with_next_lap_sc(flags, rates).agg(F.avg(error)).first()[0]
