"""Streams against the batch operators, over several micro-batches and restarts."""

import glob
import json
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plantwatch.functions.rules import PROBABILITIES
from plantwatch.operators import ordered
from plantwatch.plans import live as live_plan
from plantwatch.sources import readers, sinks, versions
from plantwatch.streaming import live, seen
from plantwatch.streaming.alerts import alert_stream
from plantwatch.streaming.upserts import Upserts, newest_rows

START = datetime(2024, 1, 1)
SCHEMA = "reading_id long, equipment_id string, node_id string, node_name string, event_ts timestamp, x double, " + ", ".join(
    f"{p} double" for p in PROBABILITIES
) + ", anomaly_score double, predicted_failure int"


def reading(i, node="n1", seconds=None, score=0.1):
    at = START + timedelta(seconds=i if seconds is None else seconds)
    return (i, "gw", node, node.upper(), at, float(i % 13), *[score] * 5, score, int(score >= 0.5))


def scorer(rows):
    level = F.aggregate("frame", F.lit(0.0), lambda s, r: s + F.get(r, F.lit(0))) / 100.0
    scored = rows.withColumns({p: level for p in PROBABILITIES})
    return scored.withColumn("anomaly_score", level).withColumn("predicted_failure", (level >= 0.5).cast("int"))


class Feed:
    """Batches written one after the other into the folder a stream reads."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.work = spark, str(tmp_path / "in"), str(tmp_path)

    def add(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).parquet(self.path)

    def score(self, sink=None, **options):
        query = live.windowed_scores(
            self.stream(), ["node_id"], ["x"], scorer, sink or live.write_batches(f"{self.work}/out"),
            f"{self.work}/checkpoint", available_now=True, **options,
        )
        query.awaitTermination()
        return query

    def scores(self):
        rows = self.spark.read.parquet(f"{self.work}/out").collect()
        return {(r.node_id, r.reading_id): round(r.anomaly_score, 6) for r in rows}


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_scores_start_with_the_twentieth_reading(feed):
    feed.add([reading(i) for i in range(19)])
    feed.score()
    assert set(feed.scores().values()) == {0.1}
    feed.add([reading(19)])
    feed.score()
    assert feed.scores()["n1", 19] == round(sum(i % 13 for i in range(20)) / 100, 6)


def test_scores_over_batches_equal_one_table(spark, feed):
    rows = [reading(i, node) for i in range(60) for node in ("n1", "n2") if node == "n1" or i % 2]
    for lo in (0, 13, 14, 50):
        hi = {0: 13, 13: 14, 14: 50, 50: 60}[lo]
        feed.add([r for r in rows if lo <= r[0] < hi])
        feed.score()
    table = spark.createDataFrame(rows, SCHEMA)
    framed = scorer(ordered.trailing_frames(table, ["node_id"], list(live.ORDER), ["x"], 20))
    expected = {(r.node_id, r.reading_id): round(r.anomaly_score, 6) for r in framed.collect()}
    got = feed.scores()
    assert len(got) == len(rows)
    assert {k: got[k] for k in expected} == expected
    assert all(got[k] == 0.1 for k in set(got) - set(expected))


def test_late_reading_passes_through(feed):
    feed.add([reading(i) for i in range(25)])
    feed.score()
    feed.add([reading(100, seconds=3, score=0.9), reading(25)])
    feed.score()
    got = feed.scores()
    assert got["n1", 100] == 0.9
    assert got["n1", 25] == round(sum(i % 13 for i in range(6, 26)) / 100, 6)


def test_a_batch_that_failed_is_scored_again_from_the_same_state(feed):
    feed.add([reading(i) for i in range(30)])
    feed.score()
    feed.add([reading(i) for i in range(30, 40)])

    def broken(batch, batch_id):
        batch.count()
        raise OSError("the sink is gone")

    with pytest.raises(Exception, match="the sink is gone"):
        feed.score(broken)
    feed.score()
    got = feed.scores()
    assert len(got) == 40
    assert got["n1", 35] == round(sum(i % 13 for i in range(16, 36)) / 100, 6)


def test_values_pass_the_state_as_they_are(spark, feed):
    """Large numbers, nulls and NaN: nothing goes through a float."""
    big = 2**60 + 1
    rows = [(big + i, "gw", "n", None, START + timedelta(microseconds=i), [None, float("nan"), 1e-310][i % 3], *[None] * 5, float("nan"), None) for i in range(25)]
    feed.add(rows)
    seen = []

    def scoring(batch):
        seen.append([r.frame for r in batch.orderBy("reading_id").collect()])
        return scorer(batch)

    live.windowed_scores(
        feed.stream(), ["node_id"], ["x"], scoring, live.write_batches(f"{feed.work}/out"), f"{feed.work}/checkpoint", available_now=True
    ).awaitTermination()
    back = spark.read.parquet(f"{feed.work}/out").orderBy("reading_id").collect()
    assert [r.reading_id for r in back] == [big + i for i in range(25)]
    assert [r.event_ts for r in back] == [r[4] for r in rows]
    assert back[0].x is None and back[1].x != back[1].x and back[2].x == 1e-310 and back[0].node_name is None
    first = [x for (x,) in seen[0][0]]
    assert first[0] is None and first[1] != first[1] and first[2] == 1e-310 and len(first) == 20


def test_a_batch_touches_the_state_of_its_own_keys(feed):
    feed.add([reading(i, f"n{i % 40}") for i in range(400)])
    first = feed.score().recentProgress
    feed.add([reading(1000, "n7")])
    second = feed.score().recentProgress
    updated = lambda progress: max(p["stateOperators"][0]["numRowsUpdated"] for p in progress if p["stateOperators"])
    # The list of one key is at most 19 rows; forty keys hold ten each.
    assert updated(first) >= 400 and updated(second) <= 20


def test_idle_keys_expire(feed):
    feed.add([reading(i) for i in range(25)])
    feed.score(idle_ms=1)
    feed.add([reading(i) for i in range(25, 30)])
    feed.score(idle_ms=1)
    got = feed.scores()
    assert got["n1", 24] != 0.1 and all(got["n1", i] == 0.1 for i in range(25, 30))


def test_repeats_inside_a_batch_count_once(feed):
    feed.add([reading(i) for i in range(25)] + [reading(i) for i in range(25)])
    feed.score()
    got = feed.scores()
    assert len(got) == 25 and got["n1", 24] == round(sum(i % 13 for i in range(5, 25)) / 100, 6)


def drain(stream, folder):
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start(
        f"{folder}/o"
    ).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/o")


def test_duplicates_across_batches(feed, tmp_path):
    feed.add([reading(1), reading(1), reading(2)])
    deduped = lambda: drain(live.dedup_stream(feed.stream()), tmp_path / "d")
    assert deduped().count() == 2
    feed.add([reading(2), reading(3)])
    assert sorted(r.reading_id for r in deduped().collect()) == [1, 2, 3]


def test_alerts_of_stream_and_table_agree(spark, feed, tmp_path):
    rows = [reading(i, score=s) for i, s in enumerate((0.1, 0.64, 0.65, 0.79, 0.8, 0.9, 0.95))]
    feed.add(rows)
    sensors = {"air_temp_k": 300.0, "process_temp_k": 310.0, "rpm": 1500, "torque_nm": 40.0, "tool_wear_min": 10}
    full = lambda df: df.withColumns({k: F.lit(v) for k, v in sensors.items()})
    streamed = drain(alert_stream(full(feed.stream())), tmp_path / "a")
    batch = alert_stream(full(spark.createDataFrame(rows, SCHEMA)))
    assert streamed.exceptAll(batch).count() == 0 and streamed.count() == batch.count() == 5
    assert [r.severity for r in batch.orderBy("reading_id").collect()] == ["medium", "medium", "high", "critical", "critical"]
    assert batch.select("alert_id").distinct().count() == 5


def test_late_rows_leave_closed_windows_alone(spark, feed, tmp_path):
    feed.add([reading(i, seconds=i * 60) for i in range(30)])
    run = lambda: drain(live.windowed_health(feed.stream(), "5 minutes", "10 minutes"), tmp_path / "w")
    run()
    feed.add([reading(100, seconds=0, score=0.9), reading(101, seconds=7200)])
    closed = run()
    first = closed.filter(F.col("window_start") == START).collect()
    assert [(r.total_readings, r.max_score) for r in first] == [(5, 0.1)]
    batch = live.windowed_health(spark.createDataFrame([reading(i, seconds=i * 60) for i in range(30)], SCHEMA))
    assert closed.filter(F.col("window_end") <= START + timedelta(minutes=20)).exceptAll(batch).count() == 0


def test_process_stream(spark, tmp_path):
    rows = [("T1", "MT", 11.0), ("T2", "MT", 5.0), ("T1", "BL1", 1.0)]
    spark.createDataFrame(rows, "tag string, regime string, value double").write.parquet(f"{tmp_path}/in")
    nominals = spark.createDataFrame([("T1", "MT", 10.0), ("T2", "MT", 0.0)], "tag string, regime string, nominal_value double")
    stream = spark.readStream.schema("tag string, regime string, value double").parquet(f"{tmp_path}/in")
    got = {r.tag: r.deviation_pct for r in drain(live.process_stream(stream, nominals), tmp_path / "p").collect()}
    assert got == {"T1": 10.0, "T2": 0.0}


def test_last_status(spark, feed):
    def run():
        live.last_status(feed.stream(), f"{feed.work}/status", f"{feed.work}/sc", available_now=True).awaitTermination()
        return {r.node_id: r.reading_id for r in live.read_last_status(spark, f"{feed.work}/status").collect()}

    feed.add([reading(1), reading(2), reading(1, "n2")])
    assert run() == {"n1": 2, "n2": 1}
    feed.add([reading(3), reading(0)])
    assert run() == {"n1": 3, "n2": 1}
    feed.add([reading(9, "n3"), reading(2, seconds=1)])
    assert run() == {"n1": 3, "n2": 1, "n3": 9}


def test_status_is_read_while_it_is_written(spark, tmp_path):
    """A reader beside the writer sees whole batches only: every key of a version is of the same batch."""
    import threading

    table = Upserts(str(tmp_path / "t"), ("k",), newest_rows(["k"], ["v"]), buckets=4, deltas=2, keep=3)
    batch = lambda v: spark.range(12).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    table.write(batch(0), 0)
    seen, failures, done = [], [], threading.Event()

    def read():
        try:
            while not done.is_set():
                rows = table.read(spark).collect()
                seen.append((len(rows), {r.v for r in rows}))
        except Exception as error:
            failures.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(1, 9):
        table.write(batch(v), v)
    done.set()
    reader.join()
    assert not failures and seen and all(n == 12 and len(v) == 1 for n, v in seen)
    assert {r.v for r in table.read(spark).collect()} == {8}


def test_upserts_write_the_buckets_of_a_batch_only(spark, tmp_path):
    table = Upserts(str(tmp_path / "t"), ("k",), newest_rows(["k"], ["v"]), buckets=8, deltas=3)
    table.write(spark.range(100).selectExpr("id AS k", "0 AS v"), 0)
    before = versions.newest(spark, table.path)[1]["files"]
    for v in range(1, 8):
        table.write(spark.range(5, 6).selectExpr("id AS k", f"{v} AS v"), v)
        table.write(spark.range(5, 6).selectExpr("id AS k", "99 AS v"), v)  # a repeated batch is not taken twice
    after = versions.newest(spark, table.path)[1]["files"]
    assert sum(before[b] != after[b] for b in before) == 1 and max(map(len, after.values())) <= 3
    got = {r.k: r.v for r in table.read(spark).collect()}
    assert got == {k: 7 if k == 5 else 0 for k in range(100)}


def test_a_version_that_is_half_written_does_not_count(spark, tmp_path):
    table = Upserts(str(tmp_path / "t"), ("k",), newest_rows(["k"], ["v"]))
    table.write(spark.range(3).selectExpr("id AS k", "0 AS v"), 0)
    (tmp_path / "t" / "_versions" / "2.json").write_text('{"batch": 1, "fil')
    assert table.read(spark).count() == 3
    table.write(spark.range(4).selectExpr("id AS k", "1 AS v"), 1)
    assert {r.k: r.v for r in table.read(spark).collect()} == {k: 1 for k in range(4)}
    assert not versions.publish(spark, table.path, 3, {})


def test_late_readings_change_their_window(spark, feed):
    rows = [reading(i, f"n{i % 2}", seconds=i * 60, score=0.1 + i % 7 / 10) for i in range(40)]

    def run():
        live.health_table(feed.stream(), f"{feed.work}/health", f"{feed.work}/hc", available_now=True).awaitTermination()
        return live.read_health(spark, f"{feed.work}/health")

    feed.add(rows[10:])
    run()
    feed.add(rows[:10] + [reading(100, "n1", seconds=7200, score=0.95)])
    run()
    feed.add([reading(101, "n0", seconds=5, score=0.99)])
    everything = spark.createDataFrame([*rows, reading(100, "n1", seconds=7200, score=0.95), reading(101, "n0", seconds=5, score=0.99)], SCHEMA)
    expected, got = live.windowed_health(everything), run()
    assert got.columns == expected.columns
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def test_days_that_the_filters_rule_out_are_not_read(spark, tmp_path, monkeypatch):
    asked = []
    inner = seen.past_identities
    monkeypatch.setattr(seen, "past_identities", lambda *a: asked.append(sorted(map(str, a[4]))) or inner(*a))
    lake = str(tmp_path / "lake")
    write = live.write_lake_batches(lake)

    def run(batch_id, rows):
        fresh = live.unseen_rows(spark.createDataFrame(rows, SCHEMA).coalesce(1), lake, batch_id)
        got = sorted(r.reading_id for r in fresh.collect())
        write(fresh, batch_id)
        return got

    day = 86400
    assert run(0, [reading(i, seconds=i * day) for i in range(5)]) == [0, 1, 2, 3, 4]
    assert run(1, [reading(i, seconds=(i - 10) * day) for i in range(10, 15)]) == [10, 11, 12, 13, 14]
    assert asked == []  # the same days, but nothing that was there
    assert run(2, [reading(3, seconds=3 * day), reading(12, seconds=2 * day), reading(20), reading(20), reading(21, seconds=-40 * day)]) == [20, 21]
    assert asked == [["2024-01-03", "2024-01-04"]]
    assert run(2, [reading(20), reading(3, seconds=3 * day)]) == [20]  # the batch again: it does not see itself


def test_dedup_to_lake_keeps_late_readings_and_names_them(spark, feed):
    def run():
        live.dedup_to_lake(
            feed.stream(), f"{feed.work}/lake", f"{feed.work}/dc", f"{feed.work}/late", available_now=True
        ).awaitTermination()
        rows = lambda name: sorted(r.reading_id for r in sinks.read_batches(spark, f"{feed.work}/{name}").collect())
        return rows("lake"), rows("late") if (feed.path and len(list(__import__("pathlib").Path(f"{feed.work}/late").glob("equipment*")))) else []

    feed.add([reading(i, seconds=i * 60) for i in range(30)])
    assert run() == (list(range(30)), [])
    feed.add([reading(3, seconds=180), reading(40, seconds=60), reading(41, seconds=1700)])
    assert run() == ([*range(30), 40, 41], [40])


def test_compaction_in_place(spark, tmp_path):
    path = str(tmp_path / "lake")
    write = live.write_lake_batches(path)
    rows = [reading(i, seconds=i * 3000) for i in range(60)]
    for k in range(5):
        write(spark.createDataFrame(rows[k::5], SCHEMA).repartition(4), k)
    files = lambda df: len(df.inputFiles())
    before = sinks.read_batches(spark, path)
    days = [r[0] for r in before.select("event_date").distinct().collect()]
    numbers = sorted(r.reading_id for r in before.collect())
    sinks.compact_days(spark, path, days)
    after = sinks.read_batches(spark, path)
    # A reader that began before goes on; one that begins now reads the batch that may be half written, and few files besides.
    assert sorted(r.reading_id for r in before.collect()) == sorted(r.reading_id for r in after.collect()) == numbers
    read = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    assert read(after) < read(before) / 2
    write(spark.createDataFrame([reading(500, seconds=0)], SCHEMA), 5)
    assert sinks.read_batches(spark, path).count() == 61
    for _ in range(3):
        sinks.compact_days(spark, path, days, running=False)
    assert sorted(r.reading_id for r in sinks.read_batches(spark, path).collect()) == [*numbers, 500]
    left = {p.name for p in (tmp_path / "lake").rglob("_batch=*")} | {p.name for p in (tmp_path / "lake").rglob("batch_id=*")}
    assert all(int(name.split("=")[1]) < 0 for name in left)


def test_landing_to_lake(spark, tmp_path):
    folder = tmp_path / "landing" / "gw-1"
    folder.mkdir(parents=True)
    for i in range(3):
        (folder / f"{1700000000000 + i}.json").write_text(json.dumps({"reading_id": i, "equipment_id": "gw-1"}))
    (folder / "1700000000009.json").write_text("{oops")

    def run():
        stream = readers.stream_readings(spark, str(tmp_path / "landing"), files_per_trigger=2)
        sinks.stream_to_lake(stream, f"{tmp_path}/lake", f"{tmp_path}/c", available_now=True).awaitTermination()
        return spark.read.parquet(f"{tmp_path}/lake")

    assert run().count() == 3
    (folder / "1700000000010.json").write_text(json.dumps({"reading_id": 4, "equipment_id": "gw-1"}))
    lake = run()
    assert sorted(r.reading_id for r in lake.collect()) == [0, 1, 2, 4]
    assert (tmp_path / "lake" / "equipment_id=gw-1" / "event_date=2023-11-14").is_dir()


def test_landed_messages_to_scores_and_alerts(spark, tmp_path):
    folder = tmp_path / "landing" / "gw-1"
    folder.mkdir(parents=True)
    base = {"equipment_id": "gw-1", "node_id": "n1", "node_name": "N1", "product_type": "L", "air_temp_k": 300.0, "process_temp_k": 310.0, "rpm": 1500, "torque_nm": 40.0}

    def land(numbers):
        for i in numbers:
            message = {**base, "reading_id": i, "tool_wear_min": 10 * i, "anomaly_score": 0.1, **{p: 0.1 for p in PROBABILITIES}}
            (folder / f"{1700000000000 + i * 5000}.json").write_text(json.dumps(message))

    def wear(rows):
        level = F.aggregate("frame", F.lit(0.0), lambda s, r: s + F.get(r, F.lit(4))) / F.size("frame") / 250.0
        scored = rows.withColumns({p: F.lit(0.0) for p in PROBABILITIES}).withColumn("prob_twf", level)
        return scored.withColumn("anomaly_score", level).withColumn("predicted_failure", (level >= 0.5).cast("int"))

    def run():
        live_plan.score_landed(spark, str(tmp_path / "landing"), str(tmp_path / "lake"), str(tmp_path / "work"), wear, available_now=True).awaitTermination()
        sinks.register_scored_views(spark, f"{tmp_path}/lake")
        return spark.table("scored_readings"), spark.table("scored_alerts")

    land(range(15))
    readings, alerts = run()
    assert readings.count() == 15 and alerts.count() == 0
    land(range(15, 30))
    readings, alerts = run()
    assert readings.count() == 30
    got = {r.reading_id: round(r.anomaly_score, 6) for r in readings.collect()}
    assert got[18] == 0.1 and got[19] == round(95 / 250, 6) and got[29] == round(195 / 250, 6)
    raised = {r.reading_id: (r.failure_mode, r.severity) for r in alerts.collect()}
    assert raised == {i: ("TWF", "medium") for i in range(26, 30)}
    # Half an hour late, and some deliveries repeated.
    land([-360, 28, 29, 30])
    (folder / "1700000000001.json").write_text((folder / "1700000000000.json").read_text())
    readings, alerts = run()
    numbers = sorted(r.reading_id for r in readings.collect())
    assert numbers == sorted([-360, 0, *range(31)])  # the copy under another time is a reading of its own
    days = [r[0] for r in readings.select("event_date").distinct().collect()]
    for _ in range(2):
        sinks.compact_days(spark, f"{tmp_path}/lake/scored_readings", days)
    assert sinks.read_batches(spark, f"{tmp_path}/lake/scored_readings").count() == 33


def test_scores_that_are_no_numbers_raise_no_alert(spark):
    sensors = {"air_temp_k": 300.0, "process_temp_k": 310.0, "rpm": 1500, "torque_nm": 40.0, "tool_wear_min": 10}
    rows = spark.createDataFrame([reading(1, score=float("nan")), reading(2, score=0.9)], SCHEMA).withColumns({k: F.lit(v) for k, v in sensors.items()})
    assert [r.reading_id for r in alert_stream(rows).collect()] == [2]


def test_all_topics_stream(spark, tmp_path):
    for table, start in (("alerts", readers.stream_alerts), ("process_readings", readers.stream_process)):
        folder = tmp_path / table / "gw-1"
        folder.mkdir(parents=True)
        (folder / "1700000000000.json").write_text(json.dumps({"equipment_id": "gw-1", "timestamp": "2024-05-01T10:00:00Z"}))
        rows = drain(start(spark, str(tmp_path / table)), tmp_path / f"{table}-out").collect()
        expected = "2024-05-01 10:00:00" if table == "process_readings" else "2023-11-14 22:13:20"
        assert [(r.equipment_id, str(r.event_ts)) for r in rows] == [("gw-1", expected)]


def test_a_batch_can_be_read_by_several_tasks(spark):
    from plantwatch.registry.storage import batches_of

    rows = spark.range(400_000).select(F.col("id").alias("reading_id"), F.sha2(F.col("id").cast("string"), 256).alias("node_id"))
    _, folder = batches_of(rows, 2, copies=2)
    files = glob.glob(f"{folder.removeprefix('file:')}/in/*.parquet")
    assert len(files) == 2
    for file in files:
        found = pq.ParquetFile(file).metadata
        assert found.num_rows == 400_000 and found.num_row_groups > 2
