"""Live feed: topics, completed laps, latest samples, stored and enriched laps.

Each streaming query applies a batch function to its micro-batches, so a stream and its
batch twin share one definition.  What must survive a restart is what earlier batches
stored: batch N reads the batches below N and writes its own folder, so a repeated batch
gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paddock import fixed, scratch
from paddock.functions.scalars import channel_fields, parse_lap_time, parse_temp
from paddock.operators.joins import map_cars
from paddock.operators.lookups import join_lookup
from paddock.operators.ordered import over_order
from paddock.operators.reshape import top_k
from paddock.schemas import CARS, TIMING, WEATHER
from paddock.scratch import materialise
from paddock.sources.feed import LAP_EVENT, inflate_text
from paddock.sources.ingest import append_new
from paddock.streaming.state import HighestLap


def split_topics(feed: DataFrame) -> dict[str, DataFrame]:
    """cars, timing, weather and rejects from one feed with topic and payload text.

    Other topics are ignored.  A message whose field is missing or not of its topic's shape -
    an object of cars, an object of lines, an object - goes to rejects, and only there.
    """
    other = [c for c in feed.columns if c not in ("topic", "payload")]
    known = feed.filter(F.col("topic").isin(*fixed.FEED_TOPICS))
    whole = F.try_parse_json("_text")

    def holds(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(whole, path, "variant")).startswith("OBJECT")

    def judged(rows: DataFrame, text: Column, shape: Column) -> DataFrame:
        return rows.withColumn("_text", text).withColumn("_broken", ~F.coalesce(shape, F.lit(False)))

    # Only packed messages go through Python workers.
    packed = judged(known.filter(F.col("topic") == "CarData.z"), inflate_text("payload"), holds("$.Cars"))
    shape = F.when(F.col("topic") == "TimingData", holds("$.Lines")).otherwise(holds("$"))
    plain = judged(known.filter(F.col("topic") != "CarData.z"), F.col("payload"), shape)

    def topic(name: str, schema: str) -> DataFrame:
        read = packed if name == "CarData.z" else plain.filter(F.col("topic") == name)
        return read.filter("NOT _broken").withColumn("_m", F.from_json("_text", schema))

    cars = topic("CarData.z", CARS).select(*other, F.explode("_m.Cars").alias("car_number", "entry"))
    timing = topic("TimingData", TIMING).select(*other, F.explode("_m.Lines").alias("car_number", "entry"))
    weather = topic("WeatherData", WEATHER).select(*other, "_m.TrackTemp", "_m.AirTemp")
    rejects = packed.unionByName(plain).filter("_broken").select(*feed.columns)
    return {"cars": cars, "timing": timing, "weather": weather, "rejects": rejects}


def _records(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lap records of timing rows."""
    return rows.select(
        *[c for c in columns if c != "entry"],
        F.col("entry.NumberOfLaps").alias("lap_number"),
        parse_lap_time("entry.LastLapTime.Value").alias("lap_time_seconds"),
        F.lit("UNKNOWN").alias("compound"),
        F.lit(0).alias("tyre_age_laps"),
        F.lit(True).alias("is_valid"),
        *[
            parse_lap_time(F.try_element_at(F.col("entry.Sectors"), F.lit(str(i)))["Value"]).alias(
                f"sector{i + 1}_seconds"
            )
            for i in range(3)
        ],
    )


def completed_laps(
    timing: DataFrame, seen: DataFrame | None = None, keys: Sequence[str] = ("session_id", "car_number"),
    order: str = "seq",
) -> tuple[DataFrame, DataFrame]:
    """(lap records for new highest laps, highest lap per car) from timing rows.

    A row counts when its NumberOfLaps exceeds every lap seen before for the car, in
    ``seen`` or earlier in arrival order; NULLs are ignored and skipped laps stay skipped.
    """
    keys = list(keys)
    rows = timing.select("*", F.col("entry.NumberOfLaps").alias("_lap")).filter("_lap is not null")
    ordered = over_order(rows, keys, [order], max_before={"_best": "_lap"})
    if seen is None:
        before = F.coalesce("_best", F.lit(0))
    else:
        ordered = join_lookup(ordered, seen.withColumnRenamed("highest", "_seen"), keys)
        before = F.greatest(F.coalesce("_best", F.lit(0)), F.coalesce("_seen", F.lit(0)))
    laps = _records(ordered.filter(F.col("_lap") > before), timing.columns)
    best = rows.select(*keys, "_lap")
    if seen is not None:
        best = best.unionByName(seen.select(*keys, F.col("highest").alias("_lap")))
    return laps, best.groupBy(*keys).agg(F.max("_lap").alias("highest"))


def write_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    """Write a micro-batch's rows to its own folder; repeating the batch replaces it."""
    writer = df.repartition(*by).write.partitionBy(*by) if by else df.write
    writer.mode("overwrite").option("partitionOverwriteMode", "static").format(fmt).save(f"{path}/batch_id={batch_id}")


def start_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Run ``each`` on every micro-batch; by default read what is there and stop."""

    def run(batch: DataFrame, batch_id: int) -> None:
        mark = scratch.made(batch.sparkSession)
        try:
            each(batch, batch_id)
        finally:  # what the batch cut is read by nobody once its rows are written
            scratch.clear(batch.sparkSession, mark)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def lap_completions(
    timing: DataFrame, path: str, car_map: DataFrame | None = None, clock: Callable[[], datetime] | None = None,
    stored: DataFrame | None = None, idle_hours: float = 12, order: str = "seq", **trigger,
) -> StreamingQuery:
    """Stream of timing rows to lap records under ``path``/laps.

    The highest lap of a car is keyed state (``HighestLap``); on the first start it is taken from
    ``stored`` (session_id, car_number, lap_number), later starts go on from the checkpoint.  A car
    without rows for ``idle_hours`` is dropped from the state.  With ``car_map`` the records carry
    driver_id, as ``upsert_laps`` needs it, and laps of cars that are not mapped are left out;
    ``clock`` gives created_at where the rows have no ``ts``.
    """
    keys = ["session_id", "car_number"]
    records = _records(timing.filter("entry.NumberOfLaps is not null"), timing.columns)
    begin = None
    if stored is not None:
        begin = stored.groupBy(*keys).agg(F.max("lap_number").cast("int").alias("highest")).groupBy(*keys)
    done = records.groupBy(*keys).transformWithState(
        HighestLap(order, "lap_number", int(idle_hours * 3_600_000)), records.schema, "Append", "ProcessingTime", begin
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        laps = batch
        if car_map is not None:
            laps, _ = map_cars(laps, car_map)
        if "created_at" not in laps.columns and ("ts" in laps.columns or clock):
            laps = laps.withColumn("created_at", F.col("ts") if "ts" in laps.columns else F.lit(clock()).cast("timestamp"))
        write_batch(laps, f"{path}/laps", batch_id, by=["session_id"])

    with _only_with_data(timing.sparkSession):
        return start_batches(done, each, f"{path}/checkpoint", **trigger)


@contextmanager
def _only_with_data(spark: SparkSession) -> Iterator[None]:
    """Streams started inside run no batch without rows.

    Timers of processing time ask for one more batch for ever, so a stream of what is there would
    not end; without such batches they fire in the next batch that has rows.
    """
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    held = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, held)


def read_batches(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All rows a stream wrote batch by batch."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def latest_samples(samples: DataFrame, keys: Sequence[str], value: Sequence[str], ts: str = "ts") -> DataFrame:
    """Newest sample per key, for a batch or a stream (complete or update mode)."""
    return samples.groupBy(*keys).agg(
        F.max_by(F.struct(*value), F.struct(ts, *value)).alias("_v"), F.max(ts).alias(ts)
    ).select(*keys, "_v.*", ts)


def fresh(latest: DataFrame, now, seconds: int, ts: str = "ts") -> DataFrame:
    """Samples still valid at ``now`` (a timestamp or a column)."""
    at = F.lit(now) if isinstance(now, datetime) else now
    age = F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return latest.filter((age >= 0) & (age < seconds * 1_000_000))


def car_samples(cars: DataFrame, keys: Sequence[str] = ("session_id", "car_number"), ts: str = "ts") -> DataFrame:
    """Named channels of each car message."""
    return cars.select(*keys, ts, channel_fields(F.col("entry.Channels")).alias("_c")).select(*keys, ts, "_c.*")


CHANNEL_FIELDS = ("speed_kmh", "throttle_pct", "brake", "gear", "drs")


def latest_car(cars: DataFrame, keys: Sequence[str] = ("session_id", "car_number")) -> DataFrame:
    return latest_samples(car_samples(cars, keys), keys, CHANNEL_FIELDS)


def latest_weather(weather: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Newest weather per session; a message lacking either temperature is ignored."""
    read = weather.select(
        *keys, "ts", parse_temp("TrackTemp").alias("track_temp"), parse_temp("AirTemp").alias("air_temp")
    ).filter("track_temp is not null and air_temp is not null")
    return latest_samples(read, keys, ("track_temp", "air_temp"))


def keep_latest(newest: DataFrame, batch_id: int, path: str, keys: Sequence[str], ts: str = "ts", every: int = 16) -> None:
    """Add one batch's newest samples to a store that holds a bounded number of batch folders.

    ``every`` batches make an epoch.  The first batch of epoch E folds the base of E - 1 and the
    batches of E - 1 into the base of E, in the slot of the base of E - 2; then it empties the slot
    of the batches of E - 3, which both bases hold, and takes it.  At any moment the folders present cover all
    batches, so ``read_latest`` needs no list of what is valid; a repeated batch does the same again.
    """
    spark, epoch = newest.sparkSession, batch_id // every
    value = [c for c in newest.columns if c not in (*keys, ts)]
    batches, base = (lambda e: f"{path}/latest/batches/slot={e % 3}"), (lambda e: f"{path}/latest/base/slot={e % 2}")
    if batch_id % every == 0:
        folded = newest.limit(0)
        if epoch:
            columns = newest.columns
            held = spark.read.schema(newest.schema).parquet(base(epoch - 1)).select(*columns)
            folded = latest_samples(held.unionByName(read_batches(spark, batches(epoch - 1)).select(*columns)), keys, value, ts)
        folded.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(base(epoch))
        none = spark.createDataFrame([], "x int, batch_id int").write.partitionBy("batch_id").mode("overwrite")
        none.option("partitionOverwriteMode", "static").parquet(batches(epoch))
    write_batch(newest, batches(epoch), batch_id)


def store_latest(
    samples: DataFrame, latest: Callable[[DataFrame], DataFrame], path: str,
    keys: Sequence[str] = ("session_id", "car_number"), every: int = 16, **trigger,
) -> StreamingQuery:
    """Write each batch's newest sample per key, older batches folded into one table.

    Nothing is kept in stream state: the newest of the batches' newest is the newest of
    all (``read_latest``), and samples go stale within seconds anyway.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        keep_latest(latest(batch), batch_id, path, keys, every=every)

    return start_batches(samples, each, f"{path}/checkpoint", **trigger)


def read_latest(
    spark: SparkSession, path: str, keys: Sequence[str], value: Sequence[str], ts: str = "ts", where: Column | str = "true"
) -> DataFrame:
    """Newest sample per key from two bases and the batches of at most three epochs.

    A file that a fold replaces while it is read is covered by another folder.
    Only samples ``where`` holds for take part.
    """
    reader = spark.read.option("ignoreMissingFiles", "true")
    parts = [reader.parquet(f"{path}/latest/{part}").select(*keys, *value, ts).filter(where) for part in ("base", "batches")]
    return latest_samples(parts[0].unionByName(parts[1]), keys, value, ts)


def store_updates(updates: DataFrame, path: str, **trigger) -> StreamingQuery:
    """Write the changed rows of a streaming aggregate batch by batch (update mode)."""
    return (
        updates.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: write_batch(batch, f"{path}/updates", batch_id))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last written row per key."""
    rows = read_batches(spark, f"{path}/updates")
    return top_k(rows, keys, [F.desc("batch_id")], 1).drop("batch_id")


LAP_KEYS = ("session_id", "driver_id", "lap_number")


def upsert_laps(laps: DataFrame, target: str, checkpoint: str, ts: str = "created_at", **trigger) -> StreamingQuery:
    """Append completed laps once per key, however late they come.

    Each batch appends the keys that the target lacks.  The target is partitioned by session;
    the join with the batch's sessions lets Spark read only those partitions of it.  A batch
    that is repeated after a failure finds its rows in the target.
    """
    spark = laps.sparkSession
    schema = laps.schema
    spark.createDataFrame([], schema).write.mode("append").partitionBy("session_id").parquet(target)

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = materialise(batch, "upsert")
        held = spark.read.schema(schema).parquet(target)
        touched = rows.select("session_id").distinct()
        fresh = append_new(held.join(touched, "session_id", "left_semi"), rows, LAP_KEYS, [ts])
        fresh.repartition("session_id").write.mode("append").partitionBy("session_id").parquet(target)

    return start_batches(laps, each, checkpoint, **trigger)


def enrich_laps(laps: DataFrame, channels: DataFrame, car_map: DataFrame, now) -> DataFrame:
    """Lap events with the driver's latest channels; none, stale or unmapped gives NULLs.

    ``channels`` comes from ``latest_car``; the event is nested under its session.
    """
    live = fresh(channels, now, fixed.CAR_SECONDS)
    by_driver = join_lookup(live, car_map.select("car_number", "driver_id"), ["car_number"], "inner")
    newest = top_k(by_driver, ["session_id", "driver_id"], [F.desc("ts"), F.desc("car_number")], 1)
    joined = laps.join(
        newest.select("session_id", "driver_id", *CHANNEL_FIELDS), ["session_id", "driver_id"], "left"
    )
    return joined.select(
        "session_id", F.lit("lap_completed").alias("event"),
        F.struct(*LAP_EVENT, *CHANNEL_FIELDS).alias("data"),
    )


def enrich_stream(laps: DataFrame, channels: Callable[[], DataFrame], car_map: DataFrame, path: str,
                  clock: Callable[[], datetime], **trigger) -> StreamingQuery:
    """Stream of lap events to enriched events, with channels as of each batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(enrich_laps(batch, channels(), car_map, clock()), f"{path}/events", batch_id)

    return start_batches(laps, each, f"{path}/checkpoint", **trigger)
