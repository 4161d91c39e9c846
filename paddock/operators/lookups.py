"""Joins that bring one row per key to a large, possibly skewed side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.scratch import materialise, materialise_counted

BROADCAST_ROWS = 200_000
SALTS = 64
#: A hot key holds more than a thousandth of the rows, and more rows than one task minds.
HOT_SHARE, HOT_ROWS = 1000, 10_000


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; aggregates and filters count as large as their input."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def auto_broadcast_bytes(df: DataFrame) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes, negative when switched off."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    digits = text.rstrip("bkmg")
    unit = text[len(digits):][:1]
    return int(digits) * {"k": 2**10, "m": 2**20, "g": 2**30}.get(unit, 1)


def join_lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a lookup (unique on ``on``) to ``left`` without shuffling a skewed left side.

    A lookup whose planned size is under Spark's own broadcast threshold is joined as it
    is: the planner broadcasts it.  Otherwise it is written once and counted; up to
    ``max_rows`` rows it is broadcast, beyond that hot keys are salted.
    """
    if planned_bytes(right) <= auto_broadcast_bytes(right):
        return left.join(F.broadcast(right), list(on), how)
    small, rows = materialise_counted(right, "lookup")
    if rows <= max_rows:
        return left.join(F.broadcast(small), list(on), how)
    return salted_join(left, small, on, how)


def hot_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that hold more than a HOT_SHARE-th of the rows, so fewer than HOT_SHARE keys."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = counts.filter((F.col("_n") * HOT_SHARE > total) & (F.col("_n") > HOT_ROWS)).select(*on)
    return materialise(hot.dropna(), "hot-keys")


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Inner or left equi-join that spreads each hot key of the left side over ``salts`` tasks.

    Only the right rows of hot keys are repeated.  Left rows with a NULL key match nothing
    and are spread as well.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be salted on the left side")
    on = list(on)
    hot = F.broadcast(hot_keys(left, on).withColumn("_hot", F.lit(True)))
    hashable = [f.name for f in left.schema.fields if not _holds_map(f.dataType)]
    spot = F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int")
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    spread = left.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_hot") | no_key, spot).otherwise(0)
    )
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    copies = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))
    )
    return spread.drop("_hot").join(copies.drop("_hot"), [*on, "_salt"], how).drop("_salt")


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, T.MapType)
