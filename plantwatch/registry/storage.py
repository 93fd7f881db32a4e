"""Sources and sinks: a view goes out through a sink and comes back through a reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch.functions.numbers import report_round
from plantwatch.registry.book import register, register_source, rounded
from plantwatch.registry.streams import HEALTH, drained, readings_stream
from plantwatch.schemas import AI4I_NAMES, READING_PAYLOAD, READING_TABLE
from plantwatch.session import shared_folder
from plantwatch.sources import readers, sinks
from plantwatch.streaming import live

R = rounded
SENT = [c for c in READING_PAYLOAD.names if c not in ("equipment_type", "twf", "hdf", "pwf", "osf", "rnf")]
SENT_LIST = ", ".join(SENT)


def folder_of(df) -> str:
    return shared_folder(df.sparkSession, "storage")


def landed(readings) -> str:
    """A folder of JSON lines, as a gateway sends them."""
    path = folder_of(readings)
    readings.select(*SENT).write.json(path)
    return path


# Messages in a compressed file, which only one task can read; they are about 30 MB of text.
MESSAGES = 100_000


register("landed_readings", ["readings"], f"SELECT {SENT_LIST} FROM readings")(
    lambda r: readers.read_readings(r.sparkSession, landed(r)).select(*SENT)
)


@register("streamed_readings", ["readings"], f"SELECT {SENT_LIST} FROM readings")
def _streamed(readings):
    stream = readers.stream_readings(readings.sparkSession, landed(readings)).select(*SENT)
    return drained(stream, folder_of(readings))


@register("landed_process", ["process_readings"], f"""
SELECT reading_id, equipment_id, tag, regime, {R('value', 6)} AS value, is_anomaly, timestamp,
  CAST(replace(replace(timestamp, 'T', ' '), 'Z', '') AS TIMESTAMP) AS event_ts FROM process_readings
""")
def _landed_process(process):
    """Messages repeat their field names and the texts of their instrument; compressed, they take a thirteenth of the disk."""
    path = folder_of(process)
    process.write.options(compression="gzip", maxRecordsPerFile=MESSAGES).json(path)
    back = readers.read_landed(process.sparkSession, path, "process_readings")
    value = report_round(F.col("value"), 6).alias("value")
    return back.select("reading_id", "equipment_id", "tag", "regime", value, "is_anomaly", "timestamp", "event_ts")


@register("reading_table", ["cases"], f"""
SELECT reading_id, equipment_id, event_ts AS timestamp, air_temp_k, process_temp_k, rpm, torque_nm, tool_wear_min, product_type,
  {R('anomaly_score', 6)} AS anomaly_score, predicted_failure, machine_failure, twf, hdf, pwf, osf, rnf FROM cases
""")
def _reading_table(cases):
    path = folder_of(cases)
    named = cases.withColumn("equipment_type", F.lit("mill")).withColumnRenamed("event_ts", "timestamp")
    fine = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    named.select(*READING_TABLE.names).write.options(header=True, timestampFormat=fine, timestampNTZFormat=fine).csv(path)
    back = readers.read_table_csv(cases.sparkSession, path, READING_TABLE)
    back = back.withColumn("anomaly_score", report_round(F.col("anomaly_score"), 6))
    return back.drop("equipment_type", *[f"prob_{x}" for x in ("twf", "hdf", "pwf", "osf", "rnf")])


LONG_NAMES = {short: long for long, short in AI4I_NAMES.items()}
MACHINE = ["product_type", "air_temp_k", "process_temp_k", "rpm", "torque_nm", "tool_wear_min", "machine_failure"]


def machine_rows(cases):
    """Rows under the headers of the machine table."""
    labels = [F.col(x).alias(x.upper()) for x in ("twf", "hdf", "pwf", "osf", "rnf")]
    product = F.concat("product_type", F.col("reading_id").cast("string")).alias("Product ID")
    return cases.select(F.col("reading_id").alias("UDI"), product, *[F.col(c).alias(LONG_NAMES[c]) for c in MACHINE], *labels, "anomaly_score", "predicted_failure")


@register("machine_table", ["cases"], f"""
SELECT reading_id AS "UDI", {', '.join(MACHINE)}, twf AS "TWF", rnf AS "RNF",
  CAST(CASE product_type WHEN 'L' THEN 0 WHEN 'M' THEN 1 ELSE 2 END AS INT) AS type_code FROM cases
""")
def _machine_table(cases):
    path = folder_of(cases)
    machine_rows(cases).drop("anomaly_score", "predicted_failure").write.option("header", True).csv(path)
    back = readers.read_ai4i(cases.sparkSession, path)
    return back.select("UDI", *MACHINE, "TWF", "RNF", F.col("type_code").cast("int").alias("type_code"))


@register("written_predictions", ["cases"], f"""
SELECT reading_id AS "UDI", product_type, machine_failure, twf AS "TWF", {R('anomaly_score', 6)} AS iforest_score, predicted_failure FROM cases
""")
def _predictions(cases):
    path = folder_of(cases)
    short = machine_rows(cases).withColumnsRenamed(AI4I_NAMES).withColumnRenamed("anomaly_score", "iforest_score")
    sinks.write_predictions(short, path)
    back = readers.read_predictions(cases.sparkSession, path).withColumn("iforest_score", report_round(F.col("iforest_score"), 6))
    return back.select("UDI", "product_type", "machine_failure", "TWF", "iforest_score", "predicted_failure")


LAKE = "reading_id, equipment_id, node_id, anomaly_score, event_ts, CAST(event_ts AS DATE) AS event_date"
LAKE_COLUMNS = ["reading_id", "equipment_id", "node_id", "anomaly_score", "event_ts", "event_date"]


@register("lake_views", ["readings", "alerts", "process_readings"], f"SELECT {LAKE} FROM readings")
def _lake(readings, alerts, process):
    root = folder_of(readings)
    # The shipping dates span years; the lake has a folder per day, so all rows are dated into one week.
    week = F.make_date(F.lit(2024), F.lit(1), F.dayofweek(F.col("timestamp").cast("timestamp")))
    stamped = process.withColumn("event_ts", week.cast("timestamp"))
    for name, rows in (("sensor_readings", readings), ("alerts", alerts), ("process_readings", stamped)):
        sinks.append_by_equipment(rows, f"{root}/{name}")
    sinks.register_views(readings.sparkSession, root)
    return readings.sparkSession.table("sensor_readings").select(*LAKE_COLUMNS)


@register_source("streamed_lake", ["readings"], f"SELECT {LAKE} FROM readings")
def _streamed_lake(spark, sf_dir):
    root = shared_folder(spark, "storage")
    sinks.stream_to_lake(readings_stream(spark, sf_dir), f"{root}/lake", f"{root}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{root}/lake").select(*LAKE_COLUMNS)


# On a stream a window comes out once the newest reading lies more than the delay behind its end.
@register_source("streamed_health", ["readings"], f"""
, h AS ({HEALTH.strip()})
SELECT * FROM h WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(event_ts) FROM readings) - INTERVAL 10 MINUTE
""")
def _streamed_health(spark, sf_dir):
    closed = live.windowed_health(readings_stream(spark, sf_dir), "6 hours").drop("window_end")
    return drained(closed, shared_folder(spark, "storage"))


ROW_GROUP = 4 << 20


def batches_of(readings, parts: int, copies: int = 1):
    """A stream of the readings in `parts` micro-batches that overlap in time, each reading in `copies` of them."""
    folder = folder_of(readings)
    part = F.pmod(F.col("reading_id") * 7 + F.col("_copy"), F.lit(parts))
    dealt = readings.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("_part", part).drop("_copy")
    for k in range(parts):
        # One file is one micro-batch; rows are dealt by many tasks, and row groups are small enough for many to read it.
        rows = dealt.filter(F.col("_part") == k).drop("_part").repartition(1)
        rows.write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/in")
    stream = readings.sparkSession.readStream.schema(readings.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return stream, folder


def finished(query) -> None:
    query.awaitTermination()


@register("health_table", ["readings"], HEALTH)
def _health_table(readings):
    """Every batch is late for the windows of the one before it."""
    stream, folder = batches_of(readings.withColumn("event_ts", F.col("event_ts").cast("timestamp")), 3)
    finished(live.health_table(stream, f"{folder}/health", f"{folder}/checkpoint", "6 hours", available_now=True))
    return live.read_health(readings.sparkSession, f"{folder}/health").drop("window_end")


@register("dedup_to_lake", ["readings"], f"SELECT {LAKE} FROM readings")
def _dedup_to_lake(readings):
    """Every reading is delivered twice, in different batches."""
    stream, folder = batches_of(readings.withColumn("event_ts", F.col("event_ts").cast("timestamp")), 3, copies=2)
    finished(live.dedup_to_lake(stream, f"{folder}/lake", f"{folder}/checkpoint", f"{folder}/late", available_now=True))
    return sinks.read_batches(readings.sparkSession, f"{folder}/lake").select(*LAKE_COLUMNS)


@register("compacted_lake", ["readings"], f"SELECT {LAKE} FROM readings")
def _compacted_lake(readings):
    """Two compactions in place, the second after more batches of the same days."""
    spark, folder = readings.sparkSession, folder_of(readings)
    write = live.write_lake_batches(f"{folder}/lake")
    days = [r[0] for r in readings.select(F.to_date("event_ts")).distinct().collect()]
    for k in range(4):
        write(readings.filter(F.col("reading_id") % 4 == k), k)
        if k % 2:
            sinks.compact_days(spark, f"{folder}/lake", days)
    return sinks.read_batches(spark, f"{folder}/lake").select(*LAKE_COLUMNS)


@register("chat_files", ["scenes"], "SELECT 'scene_' || CAST(scene_no AS VARCHAR) AS scene_id, CAST(2 AS INT) AS messages, category AS said FROM scenes")
def _chat(scenes):
    path = folder_of(scenes)
    part = lambda text: F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"), text.alias("text"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), F.array(part(text)).alias("content"))
    rows = scenes.select(
        F.concat(F.lit("scene_"), F.col("scene_no").cast("string")).alias("scene_id"),
        F.array(message("user", F.lit("label")), message("assistant", F.col("category"))).alias("messages"),
    )
    sinks.write_chat_jsonl(rows, path)
    back = readers.read_chat_jsonl(scenes.sparkSession, path)
    return back.select("scene_id", F.size("messages").alias("messages"), F.col("messages")[1]["content"][0]["text"].alias("said"))


@register("run_files", ["model_outputs"], """
SELECT run, 'share' AS field, CAST(ROUND(CAST(avg(CASE WHEN raw = '' THEN 0e0 ELSE 1e0 END) AS DECIMAL(38,9)), 6) AS DOUBLE) AS accuracy
FROM model_outputs GROUP BY run
""")
def _run_files(outputs):
    path = folder_of(outputs)
    rows = outputs.select("run", "sample_id", F.when(F.col("raw") == "", 0.0).otherwise(1.0).alias("share"))
    summary = rows.groupBy("run").agg(F.avg("share").alias("share"))
    sinks.write_run(rows, summary, path, {"backend": "stored"})
    back = outputs.sparkSession.read.schema("run string, field string, accuracy double").json(f"{path}/fields")
    return back.withColumn("accuracy", report_round(F.col("accuracy"), 6))
