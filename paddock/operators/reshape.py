"""Pages, top-k, schedule lookups and the alert feed."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock import fixed
from paddock.operators.lookups import join_lookup
from paddock.operators.ordered import ranked


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> tuple[DataFrame, int]:
    """One page (1-based) of an ordered list and the total row count."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1 and holds 1 to 100 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size), df.count()


def paged(df: DataFrame, order: Sequence[str], size: int = 20) -> DataFrame:
    """Every row with its page number and place in the whole ordering."""
    numbered = ranked(df, [], order, "row")
    return numbered.withColumn("page", (F.floor((F.col("row") - 1) / size) + 1).cast("bigint"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group.

    The planner limits each task's share to ``k`` rows per group before the shuffle, so
    the group's size does not matter.
    """
    spot = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_spot", spot).filter(F.col("_spot") <= k).drop("_spot")


def current_event(schedule: DataFrame, races: DataFrame, today: date) -> DataFrame:
    """Race of the first scheduled round on or after ``today``, else of the last round.

    Rounds are in ``row_order`` when the schedule has it, else in round order.
    """
    day = F.lit(today)
    ahead = F.min_by(
        F.col("round_number"),
        F.when(F.col("race_date") >= day, F.struct("row_order")),
    )
    last = F.max_by(F.col("round_number"), F.struct("row_order"))
    ordered = schedule if "row_order" in schedule.columns else schedule.withColumn(
        "row_order", F.col("round_number")
    )
    target = ordered.groupBy("season").agg(F.coalesce(ahead, last).alias("round_number"))
    return join_lookup(races, target, ["season", "round_number"], "inner")


def upcoming_sessions(schedule: DataFrame, now: datetime, minutes: int = 10) -> DataFrame:
    """First session starting within ``minutes`` of ``now`` (no row when there is none)."""
    held = [n for n, pair in fixed.SESSION_COLUMNS.items() if set(pair) <= set(schedule.columns)]
    starts = []
    for i, name in enumerate(held):
        day, time = fixed.SESSION_COLUMNS[name]
        clock = F.coalesce(F.col(time).cast("string"), F.lit("00:00:00"))
        start = F.concat(F.col(day).cast("string"), F.lit(" "), clock).try_cast("timestamp")
        starts.append(F.struct(F.lit(i).alias("place"), F.lit(name).alias("session_type"), start.alias("start")))
    rows = schedule.select("round", F.inline(F.array(*starts)))
    at = F.lit(now)
    soon = rows.filter(
        (F.col("start") >= at) & (F.col("start") <= at + F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    )
    return soon.orderBy("round", "place").limit(1).select("round", "session_type", "start")


def top_contributions(df: DataFrame, k: int = 5, column: str = "contributions") -> DataFrame:
    """Keep the ``k`` largest entries of an array<struct<feature, value, contribution>>.

    Entries keep their order on equal size and gain a direction sign.
    """
    sized = F.transform(
        column,
        lambda e, i: F.struct(
            (-F.abs(e["contribution"])).alias("size"), i.alias("at"), e["feature"].alias("feature"),
            e["value"].alias("value"), e["contribution"].alias("contribution"),
        ),
    )
    best = F.slice(F.array_sort(sized), 1, k)
    signed = F.transform(
        best,
        lambda e: F.struct(
            e["feature"].alias("feature"), e["value"].alias("value"),
            e["contribution"].alias("contribution"),
            F.when(e["contribution"] >= 0, "+").otherwise("-").alias("direction"),
        ),
    )
    return df.withColumn(column, signed)


def alert_feed(alerts: DataFrame, unread: bool = False) -> DataFrame:
    """Alerts newest first for each user, optionally unread only."""
    held = alerts.filter("read_at is null") if unread else alerts
    return held.orderBy("user_id", F.desc("triggered_at"), "id")
