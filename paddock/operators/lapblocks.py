"""Per-driver work cut into blocks of consecutive laps.

(session, driver, lap) is unique, so a block of LAPS consecutive lap numbers holds at
most LAPS rows, whatever the driver's total.  Normal races fit in block 0; then the
carry side of ``running_by_lap`` is empty and the adaptive planner drops its join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAPS = 4096
KEYS = ("session_id", "driver_id")


def block_of(lap: str | Column, laps: int = LAPS) -> Column:
    lap = F.col(lap) if isinstance(lap, str) else lap
    return F.floor(lap / F.lit(laps)).cast("int")


def running_by_lap(
    df: DataFrame,
    sums: Mapping[str, str],
    keys: Sequence[str] = KEYS,
    lap: str = "lap_number",
    laps: int = LAPS,
) -> DataFrame:
    """Running sums per driver in lap order, {new column: source column}."""
    keys = list(keys)
    cut = df.withColumn("_block", block_of(lap, laps))
    per_block = cut.groupBy(*keys, "_block").agg(*[F.sum(c).alias(o) for o, c in sums.items()])
    before = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = per_block.select(
        *keys, "_block", *[F.sum(o).over(before).alias(f"_c_{o}") for o in sums]
    ).filter(F.col("_block") > 0)
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(lap)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = cut.select("*", *[F.sum(c).over(inside).alias(f"_s_{o}") for o, c in sums.items()])
    joined = local.join(carry, [*keys, "_block"], "left")
    held = {o: F.col(f"_s_{o}") for o in sums}
    moved = {o: F.col(f"_c_{o}") for o in sums}
    return joined.select(
        *df.columns,
        *[F.coalesce(held[o] + moved[o], held[o], moved[o]).alias(o) for o in sums],
    )


def attach_per_driver(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str] = KEYS,
    lap: str = "lap_number",
    how: str = "left",
    laps: int = LAPS,
) -> DataFrame:
    """Join per-driver values (one row per ``keys``, with ``last_lap``) to lap rows.

    The per-driver side is repeated once per block, so a driver with very many laps is
    joined block by block.
    """
    copies = stats.withColumn(
        "_block", F.explode(F.sequence(F.lit(0), block_of("last_lap", laps)))
    ).drop("last_lap")
    cut = df.withColumn("_block", block_of(lap, laps))
    return cut.join(copies, [*keys, "_block"], how).drop("_block")
