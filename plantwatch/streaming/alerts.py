"""Score to alert: the same stateless rule on a stream and on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.functions.numbers import known
from plantwatch.functions.rules import (
    ALERT_SCORE,
    SENSORS,
    dominant_mode,
    mode_probabilities,
    severity,
)


def alert_stream(readings: DataFrame, threshold: float = ALERT_SCORE) -> DataFrame:
    """One open alert per reading whose stored score reaches the threshold.

    The alert number is a hash of the reading, so a repeated delivery gets the same number.
    """
    mode, probability = dominant_mode(mode_probabilities())
    identity = F.concat_ws("|", "equipment_id", F.col("reading_id").cast("string"), F.col("event_ts").cast("string"))
    # A score that is no number is no alert.
    return readings.filter(known(F.col("anomaly_score")) >= threshold).select(
        F.sha2(identity, 256).alias("alert_id"),
        "equipment_id",
        "node_id",
        "node_name",
        "reading_id",
        "event_ts",
        mode.alias("failure_mode"),
        probability.alias("probability"),
        severity(F.col("anomaly_score")).alias("severity"),
        "anomaly_score",
        *SENSORS,
        F.lit(0).alias("resolved"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )
