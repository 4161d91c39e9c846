"""Pit-window search, forward crossing and the session overview."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock import fixed
from paddock.functions.scalars import compound_code, compound_model, forward_fuel_load
from paddock.operators.aggregates import DRIVER
from paddock.operators.lookups import join_lookup
from paddock.operators.reshape import top_k
from paddock.plans.projection import Score, spread, stint_deltas


def pit_windows(
    state: DataFrame, score: Score, lookahead: int = fixed.PIT_LOOKAHEAD, k: int = 3
) -> DataFrame:
    """The k cheapest pit laps per driver, none at the end of the race.

    Each candidate is the stint to the stop, the stop, and the best compound to the end.
    Totals equal to nine digits are ties, taken by lap.  The stints to the stop of a driver are
    beginnings of one stint, so its laps are scored once and a candidate takes their running sum
    (``lookahead`` rows of a driver).  Stints after a stop share no lap of one age, so each
    is scored and summed.
    """
    lap = F.col("lap_number")
    held = spread(state, DRIVER).withColumns(
        {"window_start": lap + 1, "window_end": F.least(lap + lookahead, F.col("total_laps"))}
    ).filter("window_end > lap_number")

    def stint(pit_lap, part, compound, start_lap, n_laps, start_age):
        whole = {"pit_lap": pit_lap, "start_lap": start_lap, "n_laps": n_laps, "start_age": start_age}
        return F.struct(
            part.alias("part"), compound.alias("compound"), *[c.cast("int").alias(n) for n, c in whole.items()]
        )

    now = stint(F.lit(0), F.lit(""), F.col("compound"), lap + 1, F.col("window_end") - lap, F.col("tyre_age_laps"))
    later = F.transform(
        F.sequence("window_start", "window_end"),
        lambda p: F.array(*[stint(p, F.lit(c), F.lit(c), p + 1, F.col("total_laps") - p, F.lit(0)) for c in fixed.STOP_COMPOUNDS]),
    )
    window = [*DRIVER, "window_start", "window_end"]
    stints = held.withColumn("_stints", F.concat(F.array(now), F.flatten(later))).select(
        *window, "total_laps", "circuit_code", "driver_code", F.inline("_stints")
    )
    laps = stint_deltas(stints, [*window, "pit_lap", "part"], score, F.col("part") != "")
    # A lap of the current stint is the last one before a stop at the end of it.
    stop = F.when(F.col("part") == "", F.col("lap_number")).otherwise(F.col("pit_lap")).cast("int")
    parts = laps.groupBy(*window, stop.alias("pit_lap"), "part").agg(F.sum("delta").alias("_sum"))
    stops = parts.groupBy(*window, "pit_lap").agg(
        F.max(F.when(F.col("part") == "", F.col("_sum"))).alias("_last"),
        F.min(F.when(F.col("part") != "", F.col("_sum"))).alias("_rest"),
    )
    so_far = Window.partitionBy(*DRIVER).orderBy("pit_lap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = stops.select(
        *DRIVER, "pit_lap", "window_start", "window_end",
        (F.sum("_last").over(so_far) + fixed.PIT_STOP_SECONDS + F.col("_rest")).alias("projected_total_delta_seconds"),
    )
    return top_k(totals, DRIVER, [F.round("projected_total_delta_seconds", 9), F.col("pit_lap")], k)


def first_crossing(
    state: DataFrame,
    score_tyre: Score,
    score_pit: Score,
    threshold: float = fixed.PIT_CROSSING,
    horizon: int = fixed.PIT_HORIZON,
) -> DataFrame:
    """First future lap whose pit probability reaches the threshold, else the last one tried.

    ``state`` also has gap_to_car_ahead, gap_to_car_behind and safety_car_probability.
    Tyre features of offset o looked o' laps ahead equal those of offset o + o', because
    lap and age move together and fuel is fixed at 0.  So each driver needs one scored
    lap per distinct offset (54), not 40 per candidate lap.
    """
    reach = horizon + fixed.LIFE_LAPS - 1
    held = spread(state, DRIVER)
    carried = [
        "lap_number", "tyre_age_laps", "position", "total_laps", "gap_to_car_ahead",
        "gap_to_car_behind", "safety_car_probability",
    ]
    facts = F.struct(*carried)
    ahead = held.select(
        *DRIVER, facts.alias("_state"), "compound", "circuit_code", "driver_code",
        F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_m"),
    )
    tyres = score_tyre(
        ahead.select(
            *DRIVER, "_state", "_m",
            (F.col("_state.lap_number") + F.col("_m")).alias("lap_number"),
            compound_code("compound").alias("compound_encoded"),
            (F.col("_state.tyre_age_laps") + F.col("_m")).alias("tyre_age_laps"),
            F.lit(0.0).alias("fuel_adjusted_time"),
            F.col("circuit_code").alias("circuit_id_encoded"),
            F.col("driver_code").alias("driver_id_encoded"),
            compound_model("compound").alias("tyre_model"),
        )
    )
    worn = F.when(F.col("prediction") >= fixed.DEGRADED_SECONDS, F.col("_m"))
    per_driver = tyres.groupBy(*DRIVER).agg(
        F.collect_set(worn).alias("_worn"), F.first("_state").alias("_state")
    )
    last = F.least(F.lit(horizon), F.greatest(F.col("_state.total_laps") - F.col("_state.lap_number"), F.lit(1)))
    offsets = per_driver.select(
        *DRIVER, "_worn", "_state", F.explode(F.sequence(F.lit(1), last)).alias("_off")
    )
    within = F.filter(
        "_worn", lambda m: (m >= F.col("_off")) & (m < F.col("_off") + fixed.LIFE_LAPS)
    )
    lap = F.col("_state.lap_number") + F.col("_off")
    features = offsets.select(
        *DRIVER, "_off", lap.alias("_lap"),
        (F.col("_state.tyre_age_laps") + F.col("_off")).alias("current_tyre_age"),
        F.coalesce(F.array_min(within) - F.col("_off"), F.lit(fixed.LIFE_LAPS)).alias("predicted_life_remaining"),
        F.col("_state.gap_to_car_ahead").alias("gap_to_car_ahead"),
        F.col("_state.gap_to_car_behind").alias("gap_to_car_behind"),
        F.col("_state.safety_car_probability").alias("safety_car_probability"),
        (F.col("_state.total_laps") - lap).alias("laps_to_race_end"),
        F.col("_state.position").alias("position"),
        forward_fuel_load(lap, "_state.total_laps").alias("fuel_load_est"),
    )
    scored = score_pit(features).withColumn("_p", F.col("prediction").cast("double"))
    crossing = F.when(F.col("_p") >= threshold, F.col("_off"))
    at_cross = F.struct(
        F.min_by("_lap", crossing).alias("lap"), F.min_by("_p", crossing).alias("p")
    )
    picked = scored.groupBy(*DRIVER).agg(
        at_cross.alias("_c"), F.max_by("_lap", "_off").alias("_l"), F.max_by("_p", "_off").alias("_q")
    )
    return picked.select(
        *DRIVER,
        F.coalesce("_c.lap", "_l").cast("int").alias("predicted_pit_lap"),
        F.coalesce("_c.p", "_q").alias("pit_probability"),
    )


def strategy_overview(state: DataFrame, score_tyre: Score, score_pit: Score) -> DataFrame:
    """Next pit lap of every driver of every session, gaps at the cap and no safety car."""
    sizes = state.groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    rows = join_lookup(state, sizes, ["session_id"])
    place = F.when(F.col("position") > 0, F.col("position")).otherwise(F.col("_n"))
    return first_crossing(
        rows.withColumns(
            {
                "position": place,
                "gap_to_car_ahead": F.lit(fixed.MAX_GAP_SECONDS),
                "gap_to_car_behind": F.lit(fixed.MAX_GAP_SECONDS),
                "safety_car_probability": F.lit(0.0),
            }
        ),
        score_tyre,
        score_pit,
    )
