"""Reading landed messages, tables, listings of pictures and chat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantwatch.functions.rules import encode_product_type
from plantwatch.operators.scenes import CHAT_SCHEMA
from plantwatch.schemas import (
    AI4I,
    AI4I_NAMES,
    EQUIPMENT,
    EVENT_TIME,
    PAYLOADS,
    PREDICTION_NAMES,
    PREDICTIONS,
    SCENE_TABLE,
)
from plantwatch.sources.listing import picture_files

CORRUPT = "_bad"
LANDED_NAME = r"/([^/]+)/([0-9]+)\.json$"
ISO_TIME = "yyyy-MM-dd'T'HH:mm:ssX"

# Picture folders below a category folder, with their file suffix.
PICTURES = {
    "rgb": ("RGB/Corrected FOV", "JPG"),
    "thermal": ("Thermal/Raw JPG", "JPG"),
    "tiff": ("Thermal/Celsius TIFF", "TIFF"),
}


def _json_options(table: str) -> tuple[T.StructType, dict[str, str]]:
    schema = T.StructType([*PAYLOADS[table].fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "recursiveFileLookup": "true"}
    return schema, options


def with_landing_columns(df: DataFrame) -> DataFrame:
    """Take the event time, and a missing equipment, from the landing path
    `<table>/<equipment>/<milliseconds>.json`.

    Call it directly on a file source. A message with its own ISO time keeps that.
    """
    path = F.col("_metadata.file_path")
    millis = F.nullif(F.regexp_extract(path, LANDED_NAME, 2), F.lit("")).cast("long")
    landed = F.timestamp_millis(millis)
    if "timestamp" in df.columns:
        landed = F.coalesce(F.try_to_timestamp("timestamp", F.lit(ISO_TIME)), landed)
    folder = F.url_decode(F.nullif(F.regexp_extract(path, LANDED_NAME, 1), F.lit("")))
    return df.withColumns({EVENT_TIME: landed, EQUIPMENT: F.coalesce(F.col(EQUIPMENT), folder)})


def with_alert_identity(df: DataFrame) -> DataFrame:
    """Give alerts as a gateway sends them a number, which a repeated delivery gets again.

    A gateway sends neither a number nor the reading; the number is a hash of equipment, node, time, mode and score.
    """
    parts = [F.col(c).cast("string") for c in (EQUIPMENT, "node_id", EVENT_TIME, "failure_mode", "anomaly_score")]
    number = F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)
    unknown = {"reading_id": F.lit(None).cast("long"), "resolved_at": F.lit(None).cast("timestamp")}
    return df.withColumns({"alert_id": number, **unknown})


def _landed(df: DataFrame, table: str) -> DataFrame:
    named = with_landing_columns(_clean(df))
    return with_alert_identity(named) if table == "alerts" else named


def _malformed() -> Column:
    # A malformed line is never the name of an equipment; the second column is there because Spark
    # refuses to count on the corrupt-record column alone.
    return F.col(CORRUPT).isNotNull() & ~F.col(CORRUPT).eqNullSafe(F.col(EQUIPMENT))


def _clean(df: DataFrame) -> DataFrame:
    return df.filter(~_malformed()).drop(CORRUPT)


def read_landed(
    spark: SparkSession, path: str, table: str = "sensor_readings", quarantine: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Landed messages of a table; malformed ones are dropped.

    With `quarantine` the malformed lines are returned as well, with their file.
    """
    schema, options = _json_options(table)
    raw = spark.read.schema(schema).options(**options).json(path)
    good = _landed(raw, table)
    if not quarantine:
        return good
    bad = raw.filter(_malformed()).select(F.col(CORRUPT).alias("line"), F.col("_metadata.file_path").alias("file"))
    return good, bad


def read_readings(
    spark: SparkSession, path: str, quarantine: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    return read_landed(spark, path, "sensor_readings", quarantine)


def stream_landed(
    spark: SparkSession, path: str, table: str = "sensor_readings", files_per_trigger: int | None = None
) -> DataFrame:
    """Landed messages as a stream; `files_per_trigger` bounds a micro-batch."""
    schema, options = _json_options(table)
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _landed(reader.json(path), table)


def stream_readings(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return stream_landed(spark, path, "sensor_readings", files_per_trigger)


def stream_alerts(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return stream_landed(spark, path, "alerts", files_per_trigger)


def stream_process(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return stream_landed(spark, path, "process_readings", files_per_trigger)


def read_table_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Delimited table with one header line; columns go by position."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def read_ai4i(spark: SparkSession, path: str) -> DataFrame:
    """Machine table with its sensors under their short names and the encoded product grade."""
    table = spark.read.schema(AI4I).option("header", True).csv(path)
    return table.withColumnsRenamed(AI4I_NAMES).withColumn("type_code", encode_product_type(F.col("product_type")))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Exported predictions, under the names the operators use."""
    return spark.read.schema(PREDICTIONS).option("header", True).csv(path).withColumnsRenamed(PREDICTION_NAMES)


def read_scene_table(spark: SparkSession, path: str, split: bool = True) -> DataFrame:
    """Scene table with its label text; without `split` the table ends before that column."""
    schema = SCENE_TABLE if split else T.StructType(SCENE_TABLE.fields[:-1])
    return spark.read.schema(schema).options(header=True, escape='"').csv(path)


def read_scene_files(spark: SparkSession, root: str) -> DataFrame:
    """Scenes with all three pictures, as (category, stem, tiff_path, rgb_path, thermal_path).

    Folders are listed once, each by a task; only names are read, no picture content.
    """
    files = picture_files(spark, root, PICTURES)
    by_scene = files.groupBy("category", "stem").agg(*[F.min(F.when(F.col("kind") == k, F.col("path"))).alias(f"{k}_path") for k in PICTURES])
    return by_scene.dropna().select("category", "stem", "tiff_path", "rgb_path", "thermal_path")


def read_chat_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chat rows, with `split` where the files lie in folders per split."""
    schema = T.StructType(
        [T.StructField("scene_id", T.StringType()), T.StructField("messages", CHAT_SCHEMA)]
    )
    return spark.read.schema(schema).json(path)
