"""Live feed payloads and lap events."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.operators.ordered import over_order
from paddock.schemas import CARS
from paddock.scratch import new_path

LAP_EVENT = (
    "driver_id", "session_id", "lap_number", "lap_time_seconds", "compound",
    "sector1_seconds", "sector2_seconds", "sector3_seconds",
)


@F.pandas_udf(T.StringType())
def inflate_text(payload: pd.Series) -> pd.Series:
    """Base64 raw-deflate payloads to text, NULL for anything broken."""

    def one(text: str | None) -> str | None:
        try:
            return zlib.decompress(base64.b64decode(text), -zlib.MAX_WBITS).decode()
        except (TypeError, ValueError, zlib.error):
            return None

    return payload.map(one, na_action="ignore")


# A filter on the text is not pushed below the call, which would then run twice in each task.
inflate_text = inflate_text.asNondeterministic()


def inflate_cars(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(one row per car with its channels and JSON entry, rows that could not be read)."""
    read = df.withColumn("_cars", F.from_json(inflate_text(payload), CARS)["Cars"])
    cars = read.filter("_cars is not null").select(
        *df.columns, F.explode("_cars").alias("car_number", "entry")
    )
    return cars, read.filter("_cars is null").drop("_cars")


def lap_event(prefix: str = "") -> Column:
    """JSON text of the lap summary, NULL fields included."""
    fields = [F.col(f"{prefix}{c}").alias(c) for c in LAP_EVENT]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def lap_event_json(laps: DataFrame) -> DataFrame:
    return laps.select("session_id", lap_event().alias("value"))


def replay_laps(laps: DataFrame, session_id=None, batches: int = 10, path: str | None = None) -> str:
    """Write timed lap events as JSON in numbered batches of (lap, driver) order, of one session
    or (``session_id`` None) of all of them side by side.

    Rows are cut into ``batches`` equal runs of the order; ``replay_stream`` plays them.
    Returns the folder.
    """
    spark = laps.sparkSession
    path = path or new_path(spark, "replay")
    timed = laps.filter(F.col("lap_time_seconds").isNotNull()).select(*LAP_EVENT)
    if session_id is not None:
        timed = timed.filter(F.col("session_id") == session_id)
    placed = over_order(timed, [], ["lap_number", "driver_id", "session_id"], rank="seq")
    rows = timed.count()
    size = max(1, -(-rows // batches))
    numbered = placed.withColumn("batch", F.floor((F.col("seq") - 1) / size).cast("int"))
    (
        numbered.repartitionByRange(batches, "batch", "seq")
        .sortWithinPartitions("seq")
        .write.partitionBy("batch")
        .json(path)
    )
    return path


REPLAY_SCHEMA = (
    "driver_id string, session_id string, lap_number int, lap_time_seconds double, "
    "compound string, sector1_seconds double, sector2_seconds double, sector3_seconds double, "
    "seq bigint, batch int"
)


def replay_stream(
    spark: SparkSession, path: str, each: Callable[[DataFrame, int], None], checkpoint: str, batches: int = 10, seconds: float = 0
) -> None:
    """Play a replay folder: micro-batch i is batch i of the folder, whatever files it has.

    A clock source numbers the micro-batches, so the order does not hang on the times of files.
    A restart from the checkpoint goes on after the last finished batch.  Returns when all
    batches are played.
    """
    table = spark.read.schema(REPLAY_SCHEMA).json(path)
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def play(tick: DataFrame, batch_id: int) -> None:
        if batch_id < batches:
            each(table.filter(F.col("batch") == batch_id), batch_id)

    query = (
        clock.writeStream.foreachBatch(play).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
    )
    try:
        while not query.awaitTermination(0.2):
            if query.lastProgress and query.lastProgress["batchId"] >= batches - 1:
                break
    finally:
        query.stop()
