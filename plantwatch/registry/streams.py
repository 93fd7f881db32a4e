"""Streaming operators, run over the event table as a file stream until it is used up."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.functions.numbers import report_round
from plantwatch.functions.rules import PROBABILITIES
from plantwatch.registry.book import READINGS, register, register_source, rounded, table
from plantwatch.registry.fleet import ALERT_LIST
from plantwatch.session import shared_folder
from plantwatch.streaming import live
from plantwatch.streaming.alerts import alert_stream

R = rounded


def readings_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = (
        spark.readStream.schema(table(spark, sf_dir, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    events.createOrReplaceTempView("events_stream")
    text = re.sub(r"\bFROM events\b", "FROM events_stream", READINGS)
    return spark.sql(text).withColumn("event_ts", F.col("event_ts").cast("timestamp"))


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream to its end into a table, and read that."""
    writer = stream.writeStream.outputMode("append").format("parquet").trigger(availableNow=True)
    writer.option("checkpointLocation", f"{folder}/checkpoint").start(f"{folder}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@register_source("streamed_alerts", ["readings", "alerts"], f"""
SELECT {ALERT_LIST.replace(', resolved', '')}, reading_id, CAST(NULL AS TIMESTAMP) AS resolved_at FROM (SELECT *, alert_id AS reading_id FROM alerts)
""")
def _alerts(spark, sf_dir):
    stream = alert_stream(readings_stream(spark, sf_dir)).drop("alert_id", "event_ts", "resolved")
    return drained(stream, shared_folder(spark, "stream"))


@register_source("dedup_stream", ["readings"], "SELECT reading_id, equipment_id, node_id, anomaly_score FROM readings")
def _dedup(spark, sf_dir):
    delivered = readings_stream(spark, sf_dir).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    once = live.dedup_stream(delivered).select("reading_id", "equipment_id", "node_id", "anomaly_score")
    return drained(once, shared_folder(spark, "stream"))


HEALTH = f"""
SELECT time_bucket(INTERVAL 6 HOUR, event_ts) AS window_start, node_id, node_name, equipment_id,
  CAST(count(*) AS BIGINT) AS total_readings, {R('avg(anomaly_score)', 4)} AS avg_score, {R('max(anomaly_score)', 4)} AS max_score,
  CAST(sum(predicted_failure) AS BIGINT) AS total_failures,
  CAST(sum(CASE WHEN anomaly_score >= 0.65 THEN 1 ELSE 0 END) AS BIGINT) AS readings_in_alert,
  CASE WHEN {R('avg(anomaly_score)', 4)} >= 0.8 THEN 'CRÍTICO' WHEN {R('avg(anomaly_score)', 4)} >= 0.65 THEN 'ALERTA' ELSE 'NORMAL' END AS status
FROM readings WHERE node_id <> '' GROUP BY ALL
"""
register("windowed_health", ["readings"], HEALTH)(lambda r: live.windowed_health(r, "6 hours").drop("window_end"))


@register_source("process_stream", ["process_measured", "nominals"], f"""
SELECT m.reading_id, m.tag, m.regime, {R('m.value', 3)} AS value, CASE WHEN n.nominal_value = 0 THEN 0e0
  ELSE {R('(m.value - n.nominal_value) / abs(n.nominal_value) * 100e0', 2)} END AS deviation_pct
FROM process_measured m JOIN nominals n ON m.tag = n.tag AND m.regime = n.regime
""")
def _process(spark, sf_dir):
    from plantwatch.registry.book import view

    nominals = view(spark, sf_dir, "nominals")
    measured = view(spark, sf_dir, "process_measured").select("reading_id", "tag", "regime", "value")
    folder = shared_folder(spark, "stream")
    measured.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(measured.schema).parquet(f"{folder}/in")
    joined = live.process_stream(stream, nominals).select("reading_id", "tag", "regime", "value", "deviation_pct")
    return drained(joined, folder)


def wear_scorer(rows: DataFrame) -> DataFrame:
    """Stand-in model: the mean wear of the frame, as every probability."""
    wear = F.aggregate("frame", F.lit(0.0), lambda s, r: s + F.get(r, F.lit(0))) / F.size("frame") / 253.0
    scored = rows.withColumns({p: wear for p in PROBABILITIES})
    return scored.withColumn("anomaly_score", wear).withColumn("predicted_failure", (wear >= 0.5).cast("int"))


@register_source("windowed_scores", ["readings"], f"""
, w AS (SELECT *, row_number() OVER k AS pos, avg(CAST(tool_wear_min AS DOUBLE)) OVER (PARTITION BY node_id
    ORDER BY event_ts, reading_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / 253e0 AS wear
  FROM readings WINDOW k AS (PARTITION BY node_id ORDER BY event_ts, reading_id))
SELECT reading_id, node_id, {R('CASE WHEN pos >= 20 THEN wear ELSE anomaly_score END', 6)} AS anomaly_score,
  CAST(CASE WHEN pos >= 20 THEN wear >= 0.5 ELSE anomaly_score >= 0.5 END AS INT) AS predicted_failure FROM w
""")
def _scores(spark, sf_dir):
    folder = shared_folder(spark, "stream")
    live.windowed_scores(
        readings_stream(spark, sf_dir),
        ["node_id"],
        ["tool_wear_min"],
        wear_scorer,
        live.write_batches(f"{folder}/out"),
        f"{folder}/checkpoint",
        available_now=True,
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        "reading_id", "node_id", report_round(F.col("anomaly_score"), 6).alias("anomaly_score"), "predicted_failure"
    )


@register_source("last_status", ["readings"], """
SELECT node_id, reading_id, anomaly_score, predicted_failure FROM (SELECT *, row_number() OVER (PARTITION BY node_id
  ORDER BY event_ts DESC, reading_id DESC) AS rn FROM readings) WHERE rn = 1
""")
def _status(spark, sf_dir):
    folder = shared_folder(spark, "stream")
    live.last_status(
        readings_stream(spark, sf_dir), f"{folder}/status", f"{folder}/checkpoint", available_now=True
    ).awaitTermination()
    latest = live.read_last_status(spark, f"{folder}/status")
    return latest.select("node_id", "reading_id", "anomaly_score", "predicted_failure")
