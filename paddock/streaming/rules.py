"""Sliding-window rules over a request log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from paddock.operators.ordered import over_order
from paddock.scratch import materialise
from paddock.streaming import live
from paddock.streaming.state import NEVER, FiringRun

# Upper bounds in seconds of a latency histogram's buckets; one without bound follows.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


@dataclass(frozen=True)
class Rule:
    """A window measure compared with a limit; ``minutes`` is how long it must hold."""

    name: str
    measure: str  # p95, error_ratio or hit_rate
    size_minutes: int
    slide_minutes: int
    limit: float
    above: bool
    minutes: int

    def fires(self, value: Column) -> Column:
        return F.coalesce(value > self.limit if self.above else value < self.limit, F.lit(False))


# The three alerting rules.
RULES = (
    Rule("high_latency_p95", "p95", 5, 1, 2.0, True, 5),
    Rule("high_error_rate", "error_ratio", 3, 1, 0.01, True, 3),
    Rule("low_hit_rate", "hit_rate", 10, 1, 0.6, False, 10),
)


def _windows_of(pane: str, rule: Rule) -> Column:
    """Starts of the windows that hold a pane (the slide is the pane length)."""
    if rule.size_minutes % rule.slide_minutes:
        raise ValueError("the window size is a multiple of the slide")
    n = rule.size_minutes // rule.slide_minutes
    return F.explode(
        F.array(*[F.col(pane) - F.expr(f"INTERVAL {i * rule.slide_minutes} MINUTES") for i in range(n)])
    )


def _sums(rule: Rule) -> list[Column]:
    """What is summed over the rows of a pane or window: a fixed number of counts."""
    if rule.measure == "p95":
        within = [F.count(F.when(F.col("latency_s") <= b, 1)) for b in LATENCY_BUCKETS]
        return [c.alias(f"_s{i}") for i, c in enumerate([*within, F.count("latency_s")])]
    hit = F.col("status").between(500, 599) if rule.measure == "error_ratio" else F.col("cache_hit")
    return [F.sum(hit.cast("bigint")).alias("_s0"), F.count(F.lit(1)).alias("_s1")]


def histogram_quantile(share: float, within: Sequence[Column], total: Column, bounds: Sequence[float] = LATENCY_BUCKETS) -> Column:
    """Quantile of bucket counts, linear inside a bucket; beyond the last bound, that bound."""
    rank = share * total
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low, before = (bounds[i - 1], within[i - 1]) if i else (0.0, F.lit(0))
        out = F.when(within[i] >= rank, low + (bounds[i] - low) * (rank - before) / (within[i] - before)).otherwise(out)
    return F.when(total > 0, out)


def _value(rule: Rule) -> Column:
    if rule.measure == "p95":
        n = len(LATENCY_BUCKETS)
        return histogram_quantile(0.95, [F.col(f"_s{i}") for i in range(n)], F.col(f"_s{n}"))
    return F.try_divide(F.col("_s0"), F.col("_s1"))


def window_values(log: DataFrame, rule: Rule) -> DataFrame:
    """(window_start, value) of the rule's measure.

    Rows are first summed per pane of one slide to a fixed number of counts, so a row is not
    copied into each window that holds it; only the panes are.
    """
    return _panes_to_windows(_pane_sums(log, rule), rule)


def _names(rule: Rule) -> list[str]:
    return [f"_s{i}" for i in range(len(_sums(rule)))]


def _pane_sums(log: DataFrame, rule: Rule) -> DataFrame:
    """(_pane, counts, _newest): one row per pane of one slide, with its newest time."""
    pane = F.window("ts", f"{rule.slide_minutes} minutes")["start"].alias("_pane")
    return log.groupBy(pane).agg(*_sums(rule), F.max("ts").alias("_newest"))


def _panes_to_windows(panes: DataFrame, rule: Rule) -> DataFrame:
    names = _names(rule)
    held = panes.select(_windows_of("_pane", rule).alias("window_start"), *names)
    whole = held.groupBy("window_start").agg(*[F.sum(c).alias(c) for c in names])
    return whole.select("window_start", _value(rule).alias("value"))


def window_rules(log: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every rule's value and whether it fires, per window."""
    out = None
    for rule in rules:
        rows = window_values(log, rule).select(
            F.lit(rule.name).alias("rule"), "window_start", F.col("value").cast("double").alias("value"),
            rule.fires(F.col("value")).alias("firing"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def window_rule_stream(log: DataFrame, rule: Rule, watermark: str = "10 minutes") -> DataFrame:
    """Streaming form: sliding event-time windows over the same counts, so of the same value.

    The watermark bounds the state: a row that comes later than it is not counted
    (``window_rule_updates`` lists and counts such rows).
    """
    window = F.window("ts", f"{rule.size_minutes} minutes", f"{rule.slide_minutes} minutes")
    return (
        log.withWatermark("ts", watermark)
        .groupBy(window)
        .agg(*_sums(rule))
        .withColumn("value", _value(rule))
        .select(
            F.lit(rule.name).alias("rule"), F.col("window.start").alias("window_start"),
            F.col("value").cast("double").alias("value"), rule.fires(F.col("value")).alias("firing"),
        )
    )


def window_rule_updates(
    log: DataFrame, rule: Rule, path: str, delay_seconds: int = 600, every: int = 16, **trigger
) -> StreamingQuery:
    """Streaming form without a watermark's loss: rows correct their windows however late they come.

    Batch N adds its counts to those of its panes and stores the sums as version N of each pane
    (``keep_latest``, so a bounded number of folders is read).  It takes the versions below N, so a
    repeated batch stores the same rows.  Windows that hold a pane of the batch go to
    ``path``/updates, read by ``live.read_updates``.  Rows older than the newest time of earlier
    batches by more than ``delay_seconds`` are listed under ``path``/late with ``behind_seconds``.
    """
    names = _names(rule)
    value, reach = ["_newest", *names], (rule.size_minutes // rule.slide_minutes - 1) * rule.slide_minutes

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = materialise(_pane_sums(batch, rule), "panes")
        held, newest = None, None
        if batch_id:
            held = live.read_latest(spark, path, ["_pane"], value, "_version", F.col("_version") < batch_id)
            newest = held.agg(F.max("_newest")).first()[0]
        behind = F.unix_seconds(F.lit(newest).cast("timestamp")) - F.unix_seconds("ts")
        late = batch.withColumn("behind_seconds", behind).filter(F.col("behind_seconds") > delay_seconds)
        live.write_batch(late, f"{path}/late", batch_id)
        panes = new
        if held is not None:
            step = F.make_dt_interval(mins=F.lit(reach))
            near = F.sequence(F.col("_pane") - step, F.col("_pane") + step, F.make_dt_interval(mins=F.lit(rule.slide_minutes)))
            wanted = new.select(F.explode(near).alias("_pane")).distinct()
            known = held.join(wanted, "_pane", "left_semi").drop("_version")
            panes = known.unionByName(new).groupBy("_pane").agg(
                F.max("_newest").alias("_newest"), *[F.sum(c).alias(c) for c in names]
            )
            panes = materialise(panes, "panes")
        touched = new.select(_windows_of("_pane", rule).alias("window_start")).distinct()
        windows = _panes_to_windows(panes, rule).join(touched, "window_start", "left_semi")
        rows = windows.select(
            F.lit(rule.name).alias("rule"), "window_start", F.col("value").cast("double").alias("value"),
            rule.fires(F.col("value")).alias("firing"),
        )
        versions = panes.join(new.select("_pane"), "_pane", "left_semi").withColumn("_version", F.lit(batch_id).cast("bigint"))
        live.keep_latest(versions.select("_pane", *value, "_version"), batch_id, path, ["_pane"], "_version", every)
        live.write_batch(rows, f"{path}/updates", batch_id)

    return live.start_batches(log, each, f"{path}/checkpoint", **trigger)


def sustained_stream(log: DataFrame, rule: Rule, path: str, watermark: str = "10 minutes", **trigger) -> StreamingQuery:
    """R-11 on a stream: closed windows with firing_since and sustained, batch by batch under ``path``/windows.

    The watermark closes windows in order; the run they belong to is keyed state (``FiringRun``).
    """
    windows = window_rule_stream(log, rule, watermark).withColumn("at", F.unix_micros("window_start"))
    runs = windows.groupBy("rule").transformWithStateInPandas(
        FiringRun(rule.slide_minutes * 60_000_000), T.StructType([*windows.schema.fields, T.StructField("since", T.LongType())]),
        "Append", "None",
    )
    fired = F.col("since") > NEVER
    out = runs.select(
        "rule", "window_start", "value", "firing", F.when(fired, F.timestamp_micros("since")).alias("firing_since"),
        (fired & (F.col("at") - F.col("since") >= rule.minutes * 60_000_000)).alias("sustained"),
    )
    return live.start_batches(out, lambda b, i: live.write_batch(b, f"{path}/windows", i), f"{path}/checkpoint", **trigger)


def sustained(windows: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add firing_since and sustained: true for the rule's minutes without a gap.

    A run breaks when a window does not fire or is missing.
    """
    def per_rule(field: str) -> Column:
        out = F.lit(None).cast("int")
        for r in rules:
            out = F.when(F.col("rule") == r.name, getattr(r, field)).otherwise(out)
        return out

    step = F.make_dt_interval(mins=per_rule("slide_minutes"))
    fired = F.when(F.col("firing"), F.col("window_start"))
    rows = over_order(
        windows.withColumn("_fired", fired), ["rule"], ["window_start"], previous={"_last": "_fired"}
    )
    fresh_run = F.col("firing") & (F.col("_last").isNull() | (F.col("_last") + step < F.col("window_start")))
    marked = rows.withColumn("_begin", F.when(fresh_run, F.col("window_start"))).drop("_last", "_fired")
    runs = over_order(marked, ["rule"], ["window_start"], last_known={"_since": "_begin"})
    since = F.when(F.col("firing"), F.col("_since"))
    need = F.make_dt_interval(mins=per_rule("minutes"))
    return runs.select(
        *windows.columns, since.alias("firing_since"),
        F.coalesce(since + need <= F.col("window_start"), F.lit(False)).alias("sustained"),
    )
