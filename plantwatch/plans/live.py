"""From landed messages to scored readings and alerts, continuously."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plantwatch.functions.rules import encode_product_type
from plantwatch.operators.filters import feature_names
from plantwatch.sources.readers import stream_readings
from plantwatch.streaming.alerts import alert_stream
from plantwatch.streaming.live import READING_IDENTITY, Scorer, unseen_rows, windowed_scores, write_lake_batches


def write_scored(lake: str):
    """Sink for scored micro-batches: readings and the alerts they raise, as lake tables, replaced if repeated."""
    readings, alerts = write_lake_batches(f"{lake}/scored_readings"), write_lake_batches(f"{lake}/scored_alerts")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            readings(batch, batch_id)
            alerts(alert_stream(batch), batch_id)
        finally:
            batch.unpersist()

    return write


def score_landed(
    spark: SparkSession,
    landing: str,
    lake: str,
    work: str,
    scorer: Scorer,
    keys: Sequence[str] = ("node_id",),
    features: Sequence[str] | None = None,
    size: int = 20,
    files_per_trigger: int | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Read landed readings, score the frames, write readings and alerts to the lake.

    Every reading is written once: repeated deliveries are recognised by what the lake holds of their day, so a late
    reading is never lost. One that is not newer than its node's last keeps the scores it came with.

    `work` is a folder in shared storage for state and progress. With key "equipment_id" the frames
    mix the nodes of a gateway, as a gateway does that keeps one buffer.
    """
    stream = stream_readings(spark, landing, files_per_trigger)
    coded = stream.withColumn("type_code", encode_product_type(F.col("product_type")).cast("double"))
    return windowed_scores(
        coded,
        keys,
        list(features or feature_names()),
        scorer,
        write_scored(lake),
        f"{work}/checkpoint",
        size,
        identity=READING_IDENTITY,
        available_now=available_now,
        unseen=lambda batch, batch_id: unseen_rows(batch, f"{lake}/scored_readings", batch_id),
    )
