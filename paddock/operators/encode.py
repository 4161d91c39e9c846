"""Category codes, grouped folds and key differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators.lookups import join_lookup
from paddock.operators.ordered import ranked


def code_table(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a column with codes 0..n-1, kept beside the model."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return ranked(values, [], [column], "_r").select(
        column, (F.col("_r") - 1).cast("int").alias(f"{column}_encoded")
    )


def categorical_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_encoded``; NULL gets -1."""
    return apply_codes(df, {c: code_table(df, c) for c in columns})


def apply_codes(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Encode with saved code tables; NULL and unseen values get -1."""
    out = df
    for column, table in tables.items():
        out = join_lookup(out, table, [column])
        name = f"{column}_encoded"
        out = out.withColumn(name, F.coalesce(name, F.lit(-1)))
    return out.select(*df.columns, *[f"{c}_encoded" for c in tables])


def fold_table(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Fold per group, no group in two folds: groups by size, dealt out in turn."""
    sizes = df.groupBy(group).agg((-F.count(F.lit(1))).alias("_neg"))
    numbered = ranked(sizes, [], ["_neg", group], "_r")
    folds = max(1, sizes.limit(k).count())
    return numbered.select(group, ((F.col("_r") - 1) % folds).cast("int").alias("fold"))


def group_folds(df: DataFrame, group: str = "session_id", k: int = 5) -> DataFrame:
    return join_lookup(df, fold_table(df, group, k), [group])


def model_folds(df: DataFrame, model: str, group: str, k: int = 5) -> DataFrame:
    """Adds ``fold``: within each model its groups by size, dealt out in turn to at most ``k`` folds."""
    sizes = df.groupBy(model, group).agg((-F.count(F.lit(1))).alias("_neg"))
    numbered = ranked(sizes, [model], ["_neg", group], "_r")
    counts = sizes.groupBy(model).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_k"))
    folds = numbered.join(counts, model).select(model, group, ((F.col("_r") - 1) % F.col("_k")).cast("int").alias("fold"))
    return join_lookup(df, folds, [model, group])


def missing_keys(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct incoming keys that the existing table does not hold."""
    return incoming.select(*keys).distinct().join(existing.select(*keys), list(keys), "left_anti")
