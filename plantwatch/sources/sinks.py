"""Writing the lake, predictions, chat rows and model runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plantwatch.schemas import (
    BATCH,
    EQUIPMENT,
    EVENT_DAY,
    EVENT_TIME,
    PAYLOADS,
    PREDICTION_NAMES,
    PREDICTIONS,
    SCENE_TABLE,
    lake_schema,
)
from plantwatch.sources import versions

PARTITIONS = (EQUIPMENT, EVENT_DAY)


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn(EVENT_DAY, F.to_date(EVENT_TIME))


def append_by_equipment(df: DataFrame, path: str) -> None:
    """Append to a table partitioned by equipment and day.

    The rebalance hint gathers the rows of a partition into few files and lets Spark split a
    partition that is too large for one task. Files are sorted by node and time, so that a query for
    one node skips most row groups.
    """
    inner = [c for c in ("node_id", "tag", EVENT_TIME) if c in df.columns]
    gathered = with_day(df).hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, *inner)
    gathered.write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def stream_to_lake(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Continuous append to a partitioned table, each row once."""
    writer = (
        with_day(stream)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy(*PARTITIONS)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def register_views(spark: SparkSession, root: str) -> None:
    """Temporary views `sensor_readings`, `alerts` and `process_readings` over the lake at `root`."""
    for table in PAYLOADS:
        schema = lake_schema(table).add(EVENT_DAY, "date")
        spark.read.schema(schema).parquet(f"{root}/{table}").createOrReplaceTempView(table)


def register_scored_views(spark: SparkSession, root: str) -> None:
    """Temporary views `scored_readings` and `scored_alerts` over what the scored stream wrote to the lake at `root`."""
    for view, table in (("scored_readings", "sensor_readings"), ("scored_alerts", "alerts")):
        schema = lake_schema(table).add(EVENT_DAY, "date")
        read_batches(spark, f"{root}/{view}", schema).createOrReplaceTempView(view)


def compact_days(spark: SparkSession, path: str, days: Sequence[date | None], running: bool = True, keep: int = 1) -> None:
    """Rewrite the given days of a table of `write_lake_batches` into few files per equipment and day, in place.

    The new files lie beside the old ones and count from the moment a version names them; `read_batches` follows it. Readers that
    began before go on with the old files, which are deleted when `keep` more compactions have been made. While the stream is
    `running`, its newest batch may be half written and stays as it is. A repeated call changes nothing that can be read.
    """
    known = versions.newest(spark, path)
    before = known[1] if known else {"days": {}, "dropped": []}
    number = versions.next_number(spark, path)
    rows = spark.read.parquet(path)
    last = rows.agg(F.max(BATCH)).first()[0]
    if last is None:
        return
    upto = last - 1 if running else last
    chosen = _in_days(list(days)) & (F.col(BATCH) <= upto) & _counted(before["days"])
    old = rows.filter(chosen)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    superseded = [r[0] for r in old.select(folder.alias("_folder")).distinct().collect()]
    inner = [c for c in ("node_id", "tag", EVENT_TIME) if c in rows.columns]
    gathered = old.withColumn(BATCH, F.lit(-number).cast("long")).hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, *inner)
    writer = gathered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*PARTITIONS, BATCH).parquet(path)
    expired = [d for n, d in before["dropped"] if n <= number - 1 - keep]
    content = {
        "days": {**before["days"], **{str(d): [upto, -number] for d in days}},
        "dropped": [[n, d] for n, d in before["dropped"] if d not in expired] + [[number, d] for d in superseded],
    }
    if not versions.publish(spark, path, number, content):
        raise RuntimeError(f"another compaction of {path} was first")
    for place in expired:
        versions.remove(spark, place)
    versions.forget(spark, path, number - 1 - keep)


def _in_days(days: Sequence[date | None]) -> Column:
    """Whether a row is of one of these days; None stands for rows without a day."""
    found = F.col(EVENT_DAY).isin([d for d in days if d is not None])
    return found | F.col(EVENT_DAY).isNull() if None in days else found


def _counted(days: Mapping[str, Sequence[int]]) -> Column:
    """Whether a version counts a row: what was compacted, and batches after that; elsewhere what the stream wrote."""
    by_version: dict[tuple[int, int], list[date | None]] = {}
    for day, (upto, compact) in days.items():
        by_version.setdefault((upto, compact), []).append(None if day == "None" else date.fromisoformat(day))
    counted = F.lit(False)
    touched = F.lit(False)
    for (upto, compact), group in by_version.items():
        here = F.coalesce(_in_days(group), F.lit(False))
        counted = counted | (here & ((F.col(BATCH) == compact) | (F.col(BATCH) > upto)))
        touched = touched | here
    return counted | (~touched & (F.col(BATCH) >= 0))


def read_batches(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table of `write_lake_batches` as of its newest compaction, without the batch numbers."""
    known = versions.newest(spark, path)
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())]))
    return reader.parquet(path).filter(_counted(known[1]["days"] if known else {})).drop(BATCH)


def create_tables(spark: SparkSession, root: str, database: str) -> None:
    """The same tables in the catalogue, for users of SQL."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{root}/_{database}'")
    for table in PAYLOADS:
        schema = lake_schema(table).add(EVENT_DAY, "date")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{database}`.`{table}` ({columns}) USING parquet "
            f"PARTITIONED BY ({', '.join(PARTITIONS)}) LOCATION '{root}/{table}'"
        )
        spark.sql(f"MSCK REPAIR TABLE `{database}`.`{table}`")


def write_predictions(df: DataFrame, path: str) -> None:
    """Identity, grade, truth, labels, score and flag of every row as delimited text with a header."""
    headers = [(PREDICTION_NAMES.get(name, name), name) for name in PREDICTIONS.names]
    kept = [F.col(f"`{column}`").alias(header) for column, header in headers]
    df.select(*kept).write.mode("overwrite").option("header", True).csv(path)


def write_scene_table(df: DataFrame, path: str) -> None:
    """Scenes with paths, label text and, where present, split as delimited text with a header."""
    kept = [c for c in SCENE_TABLE.names if c in df.columns]
    df.select(*kept).write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_chat_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, in one folder per split; parts of a message that are not set are left out."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", True)
    if "split" in df.columns:
        writer = writer.partitionBy("split")
    writer.json(path)


def write_run(results: DataFrame, summary: DataFrame, path: str, meta: Mapping[str, str] | None = None) -> None:
    """The rows of a scored run, its summary with `meta` (backend, model, split and the like), and its
    accuracy per field, as three tables."""
    fields = [c for c in summary.columns if c not in ("run", "n", "avg_latency_s", "overall")]
    plain = results.withColumn("pred", F.to_json("pred")) if "pred" in results.columns else results
    plain.write.mode("overwrite").json(f"{path}/results")
    named = summary.withColumns({name: F.lit(value) for name, value in (meta or {}).items()})
    named.write.mode("overwrite").json(f"{path}/meta")
    summary.unpivot(["run"], fields, "field", "accuracy").write.mode("overwrite").json(f"{path}/fields")
