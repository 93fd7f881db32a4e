"""Landed messages: views go out as a gateway's files land, and come back through the readers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.operators import episodes
from plantwatch.plans import reports
from plantwatch.registry.book import ORACLES, register
from plantwatch.registry.reports import AFTER_S, BEFORE_S, first_breaches
from plantwatch.registry.storage import finished
from plantwatch.schemas import EQUIPMENT, PAYLOADS
from plantwatch.session import shared_folder
from plantwatch.sources import readers, sinks
from plantwatch.sources.listing import opened
from plantwatch.streaming import live


def _write(root: str):
    """Writes the lines of one file of a landing folder."""

    def write(rows: pa.Table) -> pa.Table:
        files, top = opened(root)
        place = f"{top}/{rows['folder'][0].as_py()}"
        files.create_dir(place)
        with files.open_output_stream(f"{place}/{rows['name'][0].as_py()}") as out:
            out.write("\n".join(rows["line"].to_pylist()).encode())
        return pa.table({"files": pa.array([1], pa.int32())})

    return write


def put_files(rows: DataFrame, root: str) -> None:
    """Write rows of (folder, name, line) as files below `root`, a task for each."""
    rows.groupBy("folder", "name").applyInArrow(_write(root), "files int").agg(F.sum("files")).collect()


def land(rows: DataFrame, root: str, table: str, at, below: str = "") -> None:
    """Write messages as `<root>/<below><equipment>/<milliseconds>.json`; `at` is the landing time, the equipment is in the path alone."""
    sent = [c for c in PAYLOADS[table].names if c in rows.columns and c != EQUIPMENT]
    named = rows.select(
        F.concat(F.lit(below), F.col(EQUIPMENT)).alias("folder"),
        F.concat(F.unix_millis(at.cast("timestamp")).cast("string"), F.lit(".json")).alias("name"),
        F.to_json(F.struct(*sent)).alias("line"),
    )
    put_files(named, root)


# All readings of an equipment and day land in one file, at the time of the last.
LANDED_TIMES = """
SELECT reading_id, equipment_id, date_trunc('millisecond', max(event_ts) OVER (PARTITION BY equipment_id, CAST(event_ts AS DATE))) AS event_ts
FROM readings
"""


def by_day(readings: DataFrame) -> DataFrame:
    last = readings.groupBy(EQUIPMENT, F.to_date("event_ts").alias("_day")).agg(F.max("event_ts").alias("_landed"))
    same = [readings[EQUIPMENT] == last[EQUIPMENT], F.to_date(readings["event_ts"]) == last["_day"]]
    return readings.join(last, same).drop(last[EQUIPMENT])


@register("landing_times", ["readings"], LANDED_TIMES)
def _landing_times(readings):
    root = shared_folder(readings.sparkSession, "landing")
    land(by_day(readings), root, "sensor_readings", F.col("_landed"))
    return readers.read_readings(readings.sparkSession, root).select("reading_id", "equipment_id", "event_ts")


@register("late_landing", ["readings"], LANDED_TIMES)
def _late_landing(readings):
    """Every other day lands first; then the days between, late, with copies of what was there."""
    spark = readings.sparkSession
    root, lake = shared_folder(spark, "landing"), shared_folder(spark, "lake")
    rows = by_day(readings)
    odd = F.dayofyear("_day") % 2 == 1

    def run():
        stream = readers.stream_readings(spark, root)
        finished(live.dedup_to_lake(stream, lake, f"{lake}-checkpoint", f"{lake}-late", available_now=True))

    land(rows.filter(odd), root, "sensor_readings", F.col("_landed"))
    run()
    land(rows.filter(~odd), root, "sensor_readings", F.col("_landed"))
    land(rows.filter(odd), root, "sensor_readings", F.col("_landed"), below="again/")
    run()
    return sinks.read_batches(spark, lake).select("reading_id", "equipment_id", "event_ts")


def landed_alerts(alerts: DataFrame) -> DataFrame:
    """The alerts as a gateway sends them, without a number or a reading."""
    root = shared_folder(alerts.sparkSession, "landing")
    land(alerts, root, "alerts", F.col("event_ts"))
    return readers.read_landed(alerts.sparkSession, root, "alerts")


@register("landed_alerts_with_context", ["alerts", "stressed"], f"""
SELECT r.reading_id, CASE WHEN r.event_ts < a.at THEN 'before' WHEN r.event_ts > a.at THEN 'after' ELSE 'during' END AS phase,
  CAST(count(*) AS BIGINT) AS alerts
FROM (SELECT *, date_trunc('millisecond', event_ts) AS at FROM alerts) a JOIN stressed r ON r.node_id = a.node_id
  AND r.event_ts >= a.at - INTERVAL {BEFORE_S} SECOND AND r.event_ts <= a.at + INTERVAL {AFTER_S} SECOND
GROUP BY ALL
""")
def _landed_context(alerts, stressed):
    around = episodes.alerts_with_context(landed_alerts(alerts), stressed, BEFORE_S, AFTER_S)
    return around.groupBy("reading_id", "phase").agg(F.count(F.lit(1)).alias("alerts"))


@register("root_cause_of_landed_alerts", ["alerts", "stressed"])
def _landed_cause(alerts, stressed):
    landed = landed_alerts(alerts)
    verdicts = reports.cause_verdict(landed, first_breaches(landed, stressed)).drop("alert_id")
    return verdicts.withColumn("shown_modes", F.array_join("shown_modes", " "))


# The numbers of landed alerts are hashes of their own, and their times those of the files; everything else is as it was.
IN_MILLISECONDS = "FROM (SELECT * REPLACE (date_trunc('millisecond', event_ts) AS event_ts) FROM alerts) a JOIN stressed r"
_numbered = ORACLES["root_cause_verdict"].replace("FROM alerts a JOIN stressed r", IN_MILLISECONDS)
ORACLES["root_cause_of_landed_alerts"] = f'SELECT node_id, failure_mode, severity, shown_modes, "trigger", verdict FROM ({_numbered})'


@register("scene_listing", ["scenes"], """
SELECT category, CAST(scene_no AS VARCHAR) AS stem, CAST(scene_no AS VARCHAR) || '.TIFF' AS tiff,
  CAST(scene_no AS VARCHAR) || '.JPG' AS rgb, CAST(scene_no AS VARCHAR) || '.JPG' AS thermal
FROM scenes WHERE scene_no % 7 <> 0 AND scene_no % 5 <> 0 AND scene_no % 11 <> 0
""")
def _scene_listing(scenes):
    """Picture files of all scenes, some of which lack a kind."""
    root = shared_folder(scenes.sparkSession, "pictures")
    parts = {"rgb": 7, "thermal": 5, "tiff": 11}
    pictures = None
    for kind, gap in parts.items():
        folder, suffix = readers.PICTURES[kind]
        some = scenes.filter(F.col("scene_no") % gap != 0).select(
            F.concat(F.col("category"), F.lit(f"/{folder}")).alias("folder"),
            F.concat(F.col("scene_no").cast("string"), F.lit(f".{suffix}")).alias("name"), F.lit("x").alias("line"),
        )
        pictures = some if pictures is None else pictures.unionByName(some)
    put_files(pictures, root)
    found = readers.read_scene_files(scenes.sparkSession, root)
    last = lambda kind: F.element_at(F.split(f"{kind}_path", "/"), -1).alias(kind)
    return found.select("category", "stem", last("tiff"), last("rgb"), last("thermal"))
