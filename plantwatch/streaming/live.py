"""Streams: duplicates, windows over event time, scored frames, latest state.

The last rows of every key are keyed state of the stream. Tables that a stream keeps up to date, the newest row per key or the health
per window, are `Upserts`: a batch writes the buckets of its own keys, and readers see one version.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plantwatch.functions.numbers import report_round
from plantwatch.functions.rules import ALERT_SCORE, PROBABILITIES, health_status
from plantwatch.operators.process import attach_nominals
from plantwatch.schemas import BATCH, EQUIPMENT, EVENT_DAY
from plantwatch.sources import versions
from plantwatch.sources.sinks import with_day
from plantwatch.streaming import seen
from plantwatch.streaming.keyed import PROVIDER, ROCKSDB, keyed_frames
from plantwatch.streaming.upserts import Upserts, newest_rows, totals

READING_IDENTITY = ("equipment_id", "reading_id", "event_ts")
ORDER = ("event_ts", "reading_id")
SCORES = (*PROBABILITIES, "anomaly_score", "predicted_failure")
IDLE_MS = 30 * 24 * 3600 * 1000

Sink = Callable[[DataFrame, int], None]
Scorer = Callable[[DataFrame], DataFrame]


def dedup_stream(
    stream: DataFrame, identity: Sequence[str] = READING_IDENTITY, delay: str = "10 minutes"
) -> DataFrame:
    """One row per message, although delivery may repeat it within the delay.

    State stays small because rows that are older than the delay are dropped, first deliveries too. Where every reading has
    to arrive, use `unseen_rows` on micro-batches instead.
    """
    return stream.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(list(identity))


def unseen_rows(
    batch: DataFrame, path: str, batch_id: int, identity: Sequence[str] = READING_IDENTITY
) -> DataFrame:
    """The rows of a micro-batch that no earlier batch wrote to the table at `path`; see `seen.unseen_rows`."""
    return seen.unseen_rows(batch, path, batch_id, identity)


def dedup_to_lake(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    late_path: str | None = None,
    delay: str = "10 minutes",
    identity: Sequence[str] = READING_IDENTITY,
    available_now: bool = False,
) -> StreamingQuery:
    """Every reading once into the lake table at `path`, whatever the delay of its delivery or of a copy.

    Readings older than the newest event time of earlier batches by more than `delay` also go to `late_path`, a side output with the
    same layout, for what has closed its windows meanwhile.
    """
    write, late = write_lake_batches(path), write_lake_batches(late_path) if late_path else None
    times_path = f"{checkpoint}_newest"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = _stored(unseen_rows(_stored(batch, f"{checkpoint}_batch"), path, batch_id, identity), f"{checkpoint}_fresh")
        if late:
            known = versions.newest(spark, times_path)
            # The newest time of the batches before this one, also when this one is repeated.
            times = {int(k): v for k, v in known[1]["newest"].items() if int(k) < batch_id} if known else {}
            if times:
                cut = F.timestamp_micros(F.lit(max(times.values()))) - F.expr(f"INTERVAL {delay}")
                late(rows.where(F.col("event_ts") < cut), batch_id)
            top = rows.agg(F.max(F.unix_micros("event_ts"))).first()[0]
            latest = max([*times.values(), *([top] if top is not None else [])], default=None)
            if latest is not None:
                number = versions.next_number(spark, times_path)
                earlier = {str(k): v for k, v in times.items() if k == max(times)}
                versions.publish(spark, times_path, number, {"newest": {**earlier, str(batch_id): latest}})
                versions.forget(spark, times_path, number - 8)
        write(rows, batch_id)

    return _each_batch(stream, step, checkpoint, available_now)


def windowed_health(stream: DataFrame, length: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Health of every node per time window; works on a table as well."""
    in_alert = F.sum((F.col("anomaly_score") >= ALERT_SCORE).cast("long"))
    return (
        stream.withWatermark("event_ts", delay)
        .filter(F.col("node_id") != "")
        .groupBy(F.window("event_ts", length).alias("_w"), "node_id", "node_name", "equipment_id")
        .agg(
            F.count(F.lit(1)).alias("total_readings"),
            report_round(F.avg("anomaly_score"), 4).alias("avg_score"),
            report_round(F.max("anomaly_score"), 4).alias("max_score"),
            F.sum(F.col("predicted_failure").cast("long")).alias("total_failures"),
            in_alert.alias("readings_in_alert"),
        )
        .withColumn("status", health_status(F.col("avg_score")))
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "*")
        .drop("_w")
    )


WINDOW_KEYS = ("window_start", "window_end", "node_id", "node_name", "equipment_id")


def _health_parts(rows: DataFrame, length: str) -> DataFrame:
    """Sums, counts and maxima per window and node, which add up over batches."""
    in_alert = F.sum((F.col("anomaly_score") >= ALERT_SCORE).cast("long"))
    return (
        rows.filter(F.col("node_id") != "")
        .groupBy(F.window("event_ts", length).alias("_w"), "node_id", "node_name", "equipment_id")
        .agg(
            F.count(F.lit(1)).alias("total_readings"),
            F.sum("anomaly_score").alias("score_sum"),
            F.count("anomaly_score").alias("scores"),
            F.sum(F.col("predicted_failure").cast("long")).alias("total_failures"),
            in_alert.alias("readings_in_alert"),
            F.max("anomaly_score").alias("max_score"),
        )
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *WINDOW_KEYS[2:],
                "total_readings", "score_sum", "scores", "total_failures", "readings_in_alert", "max_score")
    )


def _health_table(path: str) -> Upserts:
    sums = ("total_readings", "score_sum", "scores", "total_failures", "readings_in_alert")
    return Upserts(path, WINDOW_KEYS, totals(WINDOW_KEYS, sums, ("max_score",)))


def health_table(
    stream: DataFrame, path: str, checkpoint: str, length: str = "5 minutes", available_now: bool = False
) -> StreamingQuery:
    """Keep the health of every node and window in a table; read it with `read_health`.

    A late reading changes the row of its window, however late it is: batches add partial sums, and nothing is ever closed.
    """
    table = _health_table(path)
    return _each_batch(stream, lambda batch, batch_id: table.write(_health_parts(batch, length), batch_id), checkpoint, available_now)


def read_health(spark: SparkSession, path: str) -> DataFrame:
    """The table of `health_table` as of its last finished batch, with the columns of `windowed_health`."""
    parts = _health_table(path).read(spark)
    return parts.select(
        "window_start", "window_end", "node_id", "node_name", "equipment_id", "total_readings",
        report_round(F.try_divide("score_sum", "scores"), 4).alias("avg_score"),
        report_round(F.col("max_score"), 4).alias("max_score"), "total_failures", "readings_in_alert",
    ).withColumn("status", health_status(F.col("avg_score")))


def process_stream(stream: DataFrame, nominals: DataFrame) -> DataFrame:
    """Process readings with their nominal value and deviation, joined with the static table."""
    return attach_nominals(stream, nominals)


def write_batches(path: str) -> Sink:
    """Sink that keeps every micro-batch in a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def write_lake_batches(path: str) -> Sink:
    """Sink into a table partitioned by equipment, day and batch; a repeated batch replaces its own files only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = with_day(batch).withColumn(BATCH, F.lit(batch_id).cast("long"))
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(EQUIPMENT, EVENT_DAY, BATCH).parquet(path)

    return write


def _stored(batch: DataFrame, folder: str) -> DataFrame:
    """The batch as written to a folder that the next one replaces, so that its plan, with its state, runs once."""
    batch.write.mode("overwrite").parquet(folder)
    return batch.sparkSession.read.schema(batch.schema).parquet(folder)


def windowed_scores(
    stream: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    scorer: Scorer,
    sink: Sink,
    checkpoint: str,
    size: int = 20,
    order: Sequence[str] = ORDER,
    identity: Sequence[str] | None = None,
    idle_ms: int | None = IDLE_MS,
    available_now: bool = False,
    unseen: Callable[[DataFrame, int], DataFrame] | None = None,
) -> StreamingQuery:
    """Score every reading from the last `size` readings of its key.

    The last readings are keyed state: a batch touches its own keys, and a key that is silent for `idle_ms` starts anew. Rows of a
    batch that agree in `identity` (key and order if it is not given) count once. `scorer` gets rows with a `frame` column and adds the
    probabilities, score and flag. Rows without a full frame, and late rows, keep the scores they came with; late ones do not enter
    the frames. `unseen` picks the rows of a batch that are new, for streams that repeat deliveries. `checkpoint` is a folder
    in shared storage.
    """
    columns = stream.columns
    framed = keyed_frames(stream, keys, order, features, size, identity or [*keys, *order], idle_ms)

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = _stored(batch, f"{checkpoint}_batch")
        if unseen:
            rows = _stored(unseen(rows, batch_id), f"{checkpoint}_unseen")
        full = ~F.col("_late") & (F.size("frame") == size)
        scored = scorer(rows.filter(full).drop(*SCORES, "_late")).select(*columns)
        sink(scored.unionByName(rows.filter(~full).select(*columns)), batch_id)

    # What keyed state needs. Without the second, state with a time to live asks for batches without data for ever.
    settings = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    spark = stream.sparkSession
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        return _each_batch(framed, step, checkpoint, available_now)  # a stream keeps the settings it starts with
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _each_batch(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def last_status(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = ("node_id",),
    order: Sequence[str] = ORDER,
    available_now: bool = False,
) -> StreamingQuery:
    """Keep the newest row per key in a table; read it with `read_last_status`, also while the stream runs."""
    table = Upserts(path, tuple(keys), newest_rows(keys, order))
    return _each_batch(
        stream, lambda batch, batch_id: table.write(batch, batch_id, {"order": list(order)}), checkpoint, available_now
    )


def read_last_status(spark: SparkSession, path: str) -> DataFrame:
    """The table of `last_status` as of its last finished batch."""
    known = versions.newest(spark, path)
    if known is None:
        raise FileNotFoundError(f"no version of {path}")
    keys = known[1]["keys"]
    return Upserts(path, tuple(keys), newest_rows(keys, known[1]["about"]["order"])).read(spark)
