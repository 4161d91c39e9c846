"""Aggregates per session, driver, season, circuit, fold and key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock import fixed
from paddock.functions.scalars import key_pattern
from paddock.operators.joins import laps_in_stints
from paddock.operators.lookups import join_lookup
from paddock.operators.ordered import exact_quantiles, over_order
from paddock.operators.reshape import top_k

DRIVER = ("session_id", "driver_id")
DRIVER_SEASON = ("driver_id", "season")


def elapsed_time(laps: DataFrame, up_to: int | str | Column | None = None,
                 time: str = "lap_time_seconds") -> DataFrame:
    """Sum of lap times per driver up to and including a lap, 0 when none is timed.

    ``up_to`` is a number, a column of ``laps`` or None for all laps.
    """
    value = F.col(time)
    if up_to is not None:
        limit = F.lit(up_to) if isinstance(up_to, int) else F.col(up_to) if isinstance(up_to, str) else up_to
        value = F.when(F.col("lap_number") <= limit, value)
    return laps.groupBy(*DRIVER).agg(F.coalesce(F.sum(value), F.lit(0)).alias("elapsed"))


def race_length(laps: DataFrame) -> DataFrame:
    """Highest lap seen in each session."""
    return laps.groupBy("session_id").agg(F.max("lap_number").alias("laps_in_session"))


def laps_in_session(laps: DataFrame) -> DataFrame:
    """Lap rows with the race length of their session."""
    return join_lookup(laps, race_length(laps), ["session_id"])


def resolve_weather(keys: DataFrame, live: DataFrame, laps: DataFrame) -> DataFrame:
    """Temperatures per (session, circuit, compound): live, else past mean, else default.

    ``live`` has session_id, live_track, live_air; ``laps`` has circuit_id.
    """
    past = laps.filter(F.col("track_temp").isNotNull()).groupBy("circuit_id", "compound").agg(
        F.avg("track_temp").alias("_track"), F.avg("air_temp").alias("_air")
    )
    rows = join_lookup(join_lookup(keys, live, ["session_id"]), past, ["circuit_id", "compound"])
    on_air = F.col("live_track").isNotNull() & F.col("live_air").isNotNull()
    return rows.select(
        *keys.columns,
        F.when(on_air, F.col("live_track"))
        .otherwise(F.coalesce("_track", F.lit(fixed.DEFAULT_TRACK_TEMP))).cast("double").alias("track_temp"),
        F.when(on_air, F.col("live_air"))
        .otherwise(F.coalesce("_air", F.lit(fixed.DEFAULT_AIR_TEMP))).cast("double").alias("air_temp"),
    )


def lap_history(laps: DataFrame, last_n: int = 5, bucket: str = "1 minute",
                times: Sequence[str] = ("sector1_seconds", "sector2_seconds", "sector3_seconds",
                                        "lap_time_seconds")) -> DataFrame:
    """Averages and counts per time bucket over each driver's last laps, newest first."""
    if not 1 <= last_n <= 100:
        raise ValueError("last_n is 1 to 100")
    recent = top_k(laps, DRIVER, [F.desc("lap_number")], last_n)
    return (
        recent.groupBy(*DRIVER, F.window("created_at", bucket)["start"].alias("bucket"))
        .agg(*[F.avg(t).alias(f"avg_{t}") for t in times], F.count(F.lit(1)).alias("lap_count"))
        .orderBy(*DRIVER, F.desc("bucket"))
    )


def build_stints(laps: DataFrame, stint: str = "stint_number") -> DataFrame:
    """One row per stint: first known compound, first and last lap."""
    known = F.when(F.col("compound").isNotNull(), F.col("lap_number"))
    return (
        laps.filter(F.col(stint).isNotNull())
        .groupBy(*DRIVER, F.col(stint).alias("stint_number"))
        .agg(
            F.min_by("compound", known).alias("compound"),
            F.min("lap_number").alias("start_lap"),
            F.max("lap_number").alias("end_lap"),
        )
        .filter("compound is not null")
    )


def stint_slopes(laps: DataFrame, stints: DataFrame, time: str = "lap_time_seconds") -> DataFrame:
    """Least-squares slope of lap time on lap number per stint with two laps or more."""
    return (
        laps_in_stints(laps, stints, time)
        .groupBy(*DRIVER, "stint_number")
        .agg(F.regr_slope(F.col(time), F.col("lap_number")).alias("avg_deg_per_lap"),
             F.count(F.lit(1)).alias("_n"))
        .filter("_n >= 2")
        .drop("_n")
    )


def sector_time_variance(laps: DataFrame, sectors: Sequence[str] = (
        "sector1_seconds", "sector2_seconds", "sector3_seconds")) -> DataFrame:
    """Mean of the known sample deviations of the three sectors per driver and season."""
    spread = laps.groupBy(*DRIVER_SEASON).agg(
        *[F.stddev_samp(s).alias(f"_d{i}") for i, s in enumerate(sectors)]
    )
    parts = [F.col(f"_d{i}") for i in range(len(sectors))]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    known = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    return spread.select(*DRIVER_SEASON, F.try_divide(total, known).alias("sector_time_variance"))


def lap_time_consistency(laps: DataFrame, time: str = "lap_time_seconds") -> DataFrame:
    """Sample deviation of valid lap times per driver and season."""
    return laps.filter("is_valid").groupBy(*DRIVER_SEASON).agg(
        F.stddev_samp(time).alias("lap_time_consistency")
    )


def stint_length_tendency(stints: DataFrame, laps: DataFrame) -> DataFrame:
    """Mean stint length; an open stint runs to the session's last lap."""
    rows = join_lookup(stints, race_length(laps), ["session_id"])
    length = F.coalesce("end_lap", "laps_in_session") - F.col("start_lap") + 1
    return rows.groupBy(*DRIVER_SEASON).agg(F.avg(length).alias("stint_length_tendency"))


def tyre_management_index(stints: DataFrame) -> DataFrame:
    """Mean z-score of stint degradation within (season, compound) per driver and season."""
    rows = stints.filter(F.col("avg_deg_per_lap").isNotNull())
    spread = rows.groupBy("season", "compound").agg(
        F.avg("avg_deg_per_lap").alias("_mean"), F.stddev_samp("avg_deg_per_lap").alias("_std")
    )
    scored = join_lookup(rows, spread, ["season", "compound"])
    z = F.try_divide(F.col("avg_deg_per_lap") - F.col("_mean"), F.col("_std"))
    return scored.groupBy(*DRIVER_SEASON).agg(F.avg(z).alias("tyre_management_index"))


def style_features(laps: DataFrame, stints: DataFrame, time: str = "lap_time_seconds",
                   sectors: Sequence[str] = ("sector1_seconds", "sector2_seconds", "sector3_seconds")) -> DataFrame:
    """The four style features per driver and season; rows missing any are dropped."""
    out = sector_time_variance(laps, sectors)
    for part in (tyre_management_index(stints), lap_time_consistency(laps, time),
                 stint_length_tendency(stints, laps)):
        out = out.join(part, list(DRIVER_SEASON))
    return out.dropna(subset=list(fixed.STYLE_FEATURES)).select(*DRIVER_SEASON, *fixed.STYLE_FEATURES)


def performance_vs_team(laps: DataFrame, contracts: DataFrame, time: str = "lap_time_seconds") -> DataFrame:
    """Driver's mean valid lap time minus the mean of driver means of the team.

    ``laps`` carries season.  NULL without a contract or valid laps.
    """
    valid = F.when(F.col("is_valid"), F.col(time))
    means = laps.groupBy("session_id", "season", "driver_id").agg(F.avg(valid).alias("driver_mean"))
    rows = means.join(contracts.select("driver_id", "season", "team_id"), ["driver_id", "season"], "left")
    teams = rows.filter("team_id is not null").groupBy("session_id", "team_id").agg(
        F.avg("driver_mean").alias("team_mean")
    )
    return join_lookup(rows, teams, ["session_id", "team_id"]).select(
        "session_id", "driver_id", "team_id",
        (F.col("driver_mean") - F.col("team_mean")).alias("performance_vs_team"),
    )


def fit_sc_rates(flags: DataFrame, min_rows: int = fixed.SC_MIN_ROWS) -> DataFrame:
    """Safety-car onsets per dry lap after lap 1, per circuit with enough rows.

    The row with circuit_name NULL is the default rate over all rows, 0 when empty.
    """
    base = flags.filter((F.col("lap_number") != 1) & ~F.col("wet_track"))
    onsets = F.sum(F.col("is_sc_event").cast("bigint"))
    per = base.groupBy("circuit_name").agg(onsets.alias("_hit"), F.count(F.lit(1)).alias("_n"))
    overall = per.agg(F.sum("_hit").alias("_hit"), F.sum("_n").alias("_n")).select(
        F.lit(None).cast("string").alias("circuit_name"),
        F.coalesce(F.try_divide("_hit", "_n"), F.lit(0.0)).alias("rate"),
    )
    rated = per.filter((F.col("_n") >= min_rows) & F.col("circuit_name").isNotNull()).select(
        "circuit_name", (F.col("_hit") / F.col("_n")).alias("rate")
    )
    return rated.unionByName(overall)


def roster(laps: DataFrame) -> DataFrame:
    return laps.select(*DRIVER).distinct()


def regression_metrics(pred: DataFrame, by: str = "fold", label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """MAE and RMSE per fold, with a row (fold NULL) holding the mean over folds."""
    error = F.col(prediction) - F.col(label)
    folds = pred.groupBy(by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.count(F.lit(1)).alias("n"),
    )
    kind = pred.schema[by].dataType
    mean = folds.agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.sum("n").alias("n"))
    return folds.unionByName(mean.withColumn(by, F.lit(None).cast(kind)))


def positive_rate(df: DataFrame, label: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("positive_rate")
    )


def auc(pred: DataFrame, by: str = "fold", label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve per fold with both classes (rank sum, ties averaged).

    Rows are counted per score first; ranks come from running counts over scores.
    """
    hit = F.col(label).cast("boolean")
    counts = pred.groupBy(by, F.col(score).alias("_score")).agg(
        F.count(F.when(hit, 1)).alias("_pos"), F.count(F.lit(1)).alias("_n")
    )
    upto = over_order(counts, [by], ["_score"], sums={"_upto": "_n"})
    rank = F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0
    folds = upto.groupBy(by).agg(
        F.sum(rank * F.col("_pos")).alias("_ranks"),
        F.sum("_pos").alias("_p"),
        F.sum(F.col("_n") - F.col("_pos")).alias("_q"),
    )
    area = (F.col("_ranks") - F.col("_p") * (F.col("_p") + 1) / 2.0) / (F.col("_p") * F.col("_q"))
    return folds.filter("_p > 0 and _q > 0").select(by, area.alias("auc"))


#: Positions a driver's counts are looked up in at once, and those of them that its rows run over before the next driver's.
POSITION_BLOCK, POSITION_RUN = 4096, 256


def _position_counts(samples: DataFrame, time: str, keys: Sequence[str]) -> DataFrame:
    placed = over_order(samples, [*keys, "sim"], [time, "driver_id"], rank="position")
    return placed.groupBy(*keys, "driver_id", "position").agg(F.count(F.lit(1)).alias("_n"))


def finish_positions(samples: DataFrame, time: str = "finish_time", keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Chance of every finishing position of a session per driver, zero chances included.

    A session has as many positions as its largest run has drivers.  Drivers meet their counts on
    blocks of positions, so rows of single positions are made last and never move.  The rows, drivers by
    positions, come by runs of positions that all drivers go through in turn: a column then holds few
    values at a time, in long or repeated runs, which files keep in a fraction of the space.
    """
    driver = [*keys, "driver_id"]
    counts = _position_counts(samples, time, keys)
    totals = counts.groupBy(*driver).agg(F.sum("_n").alias("_total"))
    field = counts.groupBy(*keys).agg(F.max("position").alias("_last"))
    block = F.floor((F.col("position") - 1) / POSITION_BLOCK).cast("bigint").alias("_block")
    held = counts.groupBy(*driver, block).agg(F.map_from_entries(F.collect_list(F.struct("position", "_n"))).alias("_counts"))
    last = F.floor((F.col("_last") - 1) / POSITION_BLOCK).cast("bigint")
    every = join_lookup(totals, field, keys).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    # Dealt out while there is a row for a block: by its bytes the planner would leave this to few tasks.
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = every.join(held, [*driver, "_block"], "left").repartitionByRange(n, *keys, "_block", "driver_id")
    end = F.least((F.col("_block") + 1) * POSITION_BLOCK, F.col("_last").cast("bigint"))
    runs = blocks.withColumn("_first", F.explode(F.sequence(F.col("_block") * POSITION_BLOCK + 1, end, F.lit(POSITION_RUN).cast("bigint"))))
    own = F.map_filter("_counts", lambda p, _: p.between(F.col("_first"), F.col("_first") + (POSITION_RUN - 1)))
    runs = runs.select(*driver, "_total", "_first", F.least(F.col("_first") + (POSITION_RUN - 1), end).alias("_end"), own.alias("_counts"))
    rows = runs.sortWithinPartitions(*keys, "_first", "driver_id").withColumn("position", F.explode(F.sequence("_first", "_end")))
    rows = rows.withColumn("position", F.col("position").cast(counts.schema["position"].dataType))
    return rows.select(
        *driver, "position", (F.coalesce(F.try_element_at("_counts", F.col("position")), F.lit(0)) / F.col("_total")).alias("probability")
    )


def finish_distribution(samples: DataFrame, time: str = "finish_time", keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Per session and driver: mean position, mean, 5 % and 95 % finish time over the runs."""
    driver = [*keys, "driver_id"]
    places = _position_counts(samples, time, keys).groupBy(*driver).agg(
        (F.sum(F.col("position") * F.col("_n")) / F.sum("_n")).alias("mean_position")
    )
    means = samples.groupBy(*driver).agg(F.avg(time).alias("mean_finish_time"))
    tails = exact_quantiles(samples, driver, time, {"finish_time_p5": 0.05, "finish_time_p95": 0.95})
    return places.join(means, driver).join(tails, driver)


def position_gain(distribution: DataFrame, grid: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Starting position minus mean finish position, rounded half to even."""
    driver = [*keys, "driver_id"]
    return distribution.join(grid, driver).select(
        *driver,
        F.rint(F.col("start_position") - F.col("mean_position")).cast("int").alias("position_gain"),
    )


def hit_rates(log: DataFrame, key: str = "cache_key", hit: str = "cache_hit") -> DataFrame:
    """Cache hit rate per key pattern."""
    return log.groupBy(key_pattern(key).alias("key_pattern")).agg(
        F.avg(F.col(hit).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("requests")
    )


def error_ratio(log: DataFrame, status: str = "status") -> DataFrame:
    """Share of 5xx answers, NULL without requests."""
    bad = F.sum(F.when(F.col(status).between(500, 599), 1).otherwise(0))
    return log.agg(F.try_divide(bad, F.count(F.lit(1))).alias("error_ratio"))
