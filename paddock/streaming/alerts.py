"""Predictions and alerts, in batches and streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paddock import fixed
from paddock.functions.scalars import alert_message, percent
from paddock.operators.aggregates import DRIVER
from paddock.operators.joins import latest_per, latest_predictions, match_subscriptions
from paddock.operators.lookups import join_lookup
from paddock.operators.windows import adjacent_pairs
from paddock.schemas import PREDICTION_MESSAGE
from paddock.streaming.live import start_batches, write_batch

MESSAGE = (
    "session_id", "driver_id", "optimal_pit_lap", "pit_probability", "undercut_score",
    "overcut_score", "tire_life_remaining", "confidence_score", "model_version",
)


def prediction_messages(predictions: DataFrame) -> DataFrame:
    held = [F.col(c) for c in MESSAGE if c in predictions.columns]
    return predictions.select("session_id", F.to_json(F.struct(*held)).alias("value"))


def write_predictions(predictions: DataFrame, path: str, batch_id: int) -> None:
    """Prediction rows and their messages, each batch in its own folder."""
    write_batch(predictions, f"{path}/strategy_predictions", batch_id)
    write_batch(prediction_messages(predictions), f"{path}/messages", batch_id)


def predict_stream(
    laps: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, **trigger
) -> StreamingQuery:
    """Score every completed lap of the stream and store rows and messages."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_predictions(score(batch), path, batch_id)

    return start_batches(laps, each, f"{path}/checkpoint", **trigger)


def pit_alerts(messages: DataFrame, subscriptions: DataFrame, users: DataFrame) -> DataFrame:
    """Pit-window alerts from prediction messages (JSON text in ``value``).

    Malformed messages are skipped.  Users without a push token are flagged.
    """
    read = messages.select(F.from_json("value", PREDICTION_MESSAGE).alias("m")).select("m.*")
    due = read.filter(
        F.col("driver_id").isNotNull()
        & (F.coalesce("pit_probability", F.lit(0.0)) >= fixed.PIT_ALERT)
    ).withColumn("alert_type", F.lit("PIT_WINDOW_OPEN"))
    matched = match_subscriptions(due, subscriptions)
    tokens = users.select(F.col("id").alias("user_id"), "fcm_token")
    body = F.format_string(
        "Driver %s: pit probability %s", F.col("driver_id"), percent("pit_probability")
    )
    return join_lookup(matched, tokens, ["user_id"]).select(
        "user_id", "session_id", "alert_type", "driver_id", body.alias("message"),
        F.col("fcm_token").isNotNull().alias("deliverable"),
    )


def undercut_threats(laps: DataFrame, predictions: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Undercut alerts for cars right behind another with a latest score over the threshold."""
    pairs = adjacent_pairs(latest_per(laps, DRIVER, ["lap_number"]))
    stored = predictions.join(laps.select("session_id").distinct(), "session_id", "left_semi")
    scores = latest_predictions(stored).select(
        "session_id", F.col("driver_id").alias("trailing_driver_id"), "undercut_score"
    )
    due = pairs.join(scores, ["session_id", "trailing_driver_id"]).filter(
        F.col("undercut_score") > fixed.UNDERCUT_ALERT
    )
    events = due.select(
        "session_id", F.col("trailing_driver_id").alias("driver_id"),
        F.lit("UNDERCUT_THREAT").alias("alert_type"),
        alert_message("trailing_driver_id", "ahead_driver_id", "undercut_score").alias("message"),
    )
    return match_subscriptions(events, subscriptions).select(
        "user_id", "session_id", "alert_type", "driver_id", "message"
    )


def alert_rows(events: DataFrame, triggered_at: datetime, batch_id: int = 0) -> DataFrame:
    """Alert table rows, one per user, all with the batch's time.

    The id is a hash of the batch and the alert, so a repeated batch writes the same ids.
    """
    return events.filter(F.col("alert_type").isin(*fixed.ALERT_TYPES)).select(
        F.sha2(
            F.to_json(F.struct(F.lit(batch_id).alias("b"), "user_id", "session_id", "alert_type", "driver_id", "message")),
            256,
        ).alias("id"),
        "user_id", "session_id", "alert_type", "driver_id", "message",
        F.lit(triggered_at).cast("timestamp").alias("triggered_at"),
        F.lit(None).cast("timestamp").alias("delivered_at"),
        F.lit(None).cast("timestamp").alias("read_at"),
    )


def write_alerts(events: DataFrame, triggered_at: datetime, path: str, batch_id: int) -> None:
    """Alert rows and their messages; the messages are made from the rows written, not matched again."""
    rows = alert_rows(events, triggered_at, batch_id)
    write_batch(rows, f"{path}/alerts", batch_id)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/alerts/batch_id={batch_id}")
    message = F.to_json(F.struct("id", "user_id", "session_id", "alert_type", "driver_id", "message", "triggered_at"))
    write_batch(rows.select("session_id", message.alias("value")), f"{path}/messages", batch_id)


def pit_alert_stream(
    messages: DataFrame, subscriptions: DataFrame, users: DataFrame, path: str,
    clock: Callable[[], datetime], **trigger,
) -> StreamingQuery:
    def each(batch: DataFrame, batch_id: int) -> None:
        write_alerts(pit_alerts(batch, subscriptions, users), clock(), path, batch_id)

    return start_batches(messages, each, f"{path}/checkpoint", **trigger)


def threat_stream(
    laps: DataFrame, stored: Callable[[], tuple[DataFrame, DataFrame]], subscriptions: DataFrame,
    path: str, clock: Callable[[], datetime], **trigger,
) -> StreamingQuery:
    """After each batch of laps, threats in the sessions it touched.

    ``stored`` gives the current lap and prediction tables.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("session_id").distinct()
        held, predictions = stored()
        now = join_lookup(held, touched, ["session_id"], "inner")
        write_alerts(undercut_threats(now, predictions, subscriptions), clock(), path, batch_id)

    return start_batches(laps, each, f"{path}/checkpoint", **trigger)
