"""Landed messages, tables, listings, chat rows and what is written back."""

import csv
import gzip
import json

import pytest
from pyspark.sql import functions as F

from plantwatch.operators import metrics, process, scenes
from plantwatch.registry import storage
from plantwatch.schemas import ALERT_TABLE, PREDICTIONS, PROCESS_PAYLOAD, READING_PAYLOAD, READING_TABLE, lake_schema
from plantwatch.sources import readers, sinks


def land(root, table, equipment, millis, message):
    folder = root / table / equipment
    folder.mkdir(parents=True, exist_ok=True)
    text = message if isinstance(message, str) else json.dumps(message)
    (folder / f"{millis}.json").write_text(text)


READING = {"reading_id": 7, "equipment_id": "gw-1", "node_id": "n-1", "rpm": 1500, "anomaly_score": 0.7, "extra": 1}


@pytest.fixture
def landed(tmp_path):
    land(tmp_path, "sensor_readings", "gw-1", 1700000000123, READING)
    land(tmp_path, "sensor_readings", "gw-1", 1700000005123, {**READING, "reading_id": 8})
    land(tmp_path, "sensor_readings", "gw 2", 1700000009000, {k: v for k, v in READING.items() if k != "equipment_id"})
    land(tmp_path, "sensor_readings", "gw-1", 1700000006000, '{"reading_id": 9, "equip')
    return tmp_path


def test_landed_messages(spark, landed):
    good, bad = readers.read_readings(spark, str(landed / "sensor_readings"), quarantine=True)
    rows = {(r.equipment_id, r.reading_id): r for r in good.collect()}
    assert set(rows) == {("gw-1", 7), ("gw-1", 8), ("gw 2", 7)}
    assert str(rows["gw-1", 7].event_ts) == "2023-11-14 22:13:20.123000"
    assert good.count() == 3 and bad.count() == 1
    assert [r.line for r in bad.collect()] == ['{"reading_id": 9, "equip']
    assert readers.read_readings(spark, str(landed / "sensor_readings")).count() == 3


def test_process_message_keeps_its_own_time(spark, tmp_path):
    land(tmp_path, "process_readings", "ug-1", 1700000000123, {"reading_id": "a", "equipment_id": "ug-1", "timestamp": "2024-05-01T10:00:00Z"})
    land(tmp_path, "process_readings", "ug-1", 1700000000124, {"reading_id": "b", "equipment_id": "ug-1", "timestamp": "soon"})
    got = {r.reading_id: str(r.event_ts) for r in readers.read_landed(spark, str(tmp_path), "process_readings").collect()}
    assert got == {"a": "2024-05-01 10:00:00", "b": "2023-11-14 22:13:20.124000"}


def test_landed_process_is_compressed_and_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "folder_of", lambda df: str(tmp_path / "landed"))
    monkeypatch.setattr(storage, "MESSAGES", 300)
    rows = [
        (f"{i % 900}-{i % 7}", f"ug-{i % 2}", f"T-{i // 50}", "Fluid é", "Flow", i / 7, "m3/h", "MT", 900.0, i / 3, i % 2, "Well", "Tank", "2024-05-01T10:00:00Z")
        for i in range(1000)
    ]
    rows += [(None,) * len(PROCESS_PAYLOAD), rows[3], ("a\nb", *rows[4][1:5], None, *rows[4][6:-1], "soon")]
    sent = spark.createDataFrame(rows, PROCESS_PAYLOAD).coalesce(1)
    got = storage._landed_process(sent).collect()
    names = ["reading_id", "equipment_id", "tag", "regime", "value", "is_anomaly", "timestamp"]
    expected = [(r["reading_id"], r["equipment_id"], r["tag"], r["regime"], r["value"] and round(r["value"], 6), r["is_anomaly"], r["timestamp"]) for r in sent.collect()]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got))) == sorted(map(repr, expected))
    assert {str(r.event_ts) for r in got} == {"2024-05-01 10:00:00", "None"}
    files = list((tmp_path / "landed").glob("part-*"))
    texts = [gzip.decompress(f.read_bytes()) for f in files]
    assert sorted(text.count(b"\n") for text in texts) == [103, 300, 300, 300]
    assert sum(f.stat().st_size for f in files) * 4 < sum(map(len, texts))
    assert set(json.loads(max(texts, key=len).splitlines()[0])) == set(PROCESS_PAYLOAD.names)


def test_lake_and_views(spark, landed, tmp_path):
    lake = tmp_path / "lake"
    readings = readers.read_readings(spark, str(landed / "sensor_readings"))
    for _ in range(2):
        sinks.append_by_equipment(readings, f"{lake}/sensor_readings")
    for table in ("alerts", "process_readings"):
        empty = readers.read_landed(spark, str(landed / "sensor_readings"), table).limit(0)
        sinks.append_by_equipment(empty.withColumn("event_ts", F.current_timestamp()), f"{lake}/{table}")
    assert sorted(p.name for p in (lake / "sensor_readings").glob("equipment_id=*")) == ["equipment_id=gw 2", "equipment_id=gw-1"]
    sinks.register_views(spark, str(lake))
    got = spark.sql("SELECT count(*) AS n, count(DISTINCT event_date) AS d FROM sensor_readings WHERE equipment_id = 'gw-1'")
    assert got.first()[:] == (4, 1)
    sinks.create_tables(spark, str(lake), "plant")
    assert spark.table("plant.sensor_readings").filter("equipment_id = 'gw 2'").count() == 2
    assert spark.table("plant.alerts").count() == 0
    spark.sql("DROP DATABASE plant CASCADE")
    plan = spark.table("sensor_readings").filter("equipment_id = 'gw-1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(equipment_id" in plan


def test_table_with_header(spark, tmp_path):
    (tmp_path / "alerts.csv").write_text(
        "id,whatever,ts,mode,p,sev,score,a,b,rpm,t,w,res,at\n"
        "x1,gw-1,2024-01-01 00:00:00,TWF,0.9,critical,0.91,300.1,310.2,1500,40.5,210,0,\n"
    )
    row = readers.read_table_csv(spark, str(tmp_path / "alerts.csv"), ALERT_TABLE).first()
    assert (row.alert_id, row.equipment_id, row.failure_mode, row.rpm, row.resolved, row.resolved_at) == (
        "x1", "gw-1", "TWF", 1500, 0, None,
    )


HEADER = (
    "UDI,Product ID,Type,Air temperature [K],Process temperature [K],Rotational speed [rpm],Torque [Nm],"
    "Tool wear [min],Machine failure,TWF,HDF,PWF,OSF,RNF\n"
)


def test_machine_table_and_predictions(spark, tmp_path):
    (tmp_path / "m.csv").write_text(HEADER + "1,M14860,M,298.1,308.6,1551,42.8,0,0,0,0,0,0,0\n2,L47181,L,298.2,308.7,1408,46.3,3,1,1,0,0,0,0\n")
    table = readers.read_ai4i(spark, str(tmp_path / "m.csv"))
    rows = table.orderBy("UDI").collect()
    assert [(r.product_type, r.type_code, r.rpm, r.machine_failure) for r in rows] == [("M", 1, 1551, 0), ("L", 0, 1408, 1)]
    scored = table.withColumn("iforest_score", F.lit(0.1)).withColumn("predicted_failure", F.lit(1))
    sinks.write_predictions(scored, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == PREDICTIONS.names and back.count() == 2
    read = readers.read_predictions(spark, str(tmp_path / "out"))
    joined = metrics.attach_predictions(table, read.select("UDI", "iforest_score", "predicted_failure"))
    assert {(r.UDI, r.rpm, r.iforest_score) for r in joined.collect()} == {(1, 1551, 0.1), (2, 1408, 0.1)}


def test_scene_files(spark, tmp_path):
    def put(category, kind, stem):
        folder, suffix = readers.PICTURES[kind]
        place = tmp_path / category / folder
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{stem}.{suffix}").write_bytes(b"x")

    for category, stem, kinds in [
        ("Fire", "00001", ("rgb", "thermal", "tiff")),
        ("Fire", "00002", ("rgb", "tiff")),
        ("No Fire", "00001", ("rgb", "thermal", "tiff")),
        ("No Fire", "00003", ("thermal", "tiff")),
    ]:
        for kind in kinds:
            put(category, kind, stem)
    files = readers.read_scene_files(spark, str(tmp_path))
    got = {(r.category, r.stem) for r in files.collect()}
    assert got == {("Fire", "00001"), ("No Fire", "00001")}
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_chat_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("fire_1", '{"fire_present": true}', "train"), ("fire_2", '{"fire_present": false}', "test")],
        "scene_id string, label_json string, split string",
    )
    chat = scenes.build_chat_rows(rows, "s", "u")
    sinks.write_chat_jsonl(chat, str(tmp_path / "chat"))
    line = next((tmp_path / "chat" / "split=train").glob("*.json")).read_text().splitlines()[0]
    written = json.loads(line)
    assert written["messages"][1]["content"][0] == {"type": "image", "image": "fire_1_rgb.jpg"}
    assert written["messages"][0]["content"] == [{"type": "text", "text": "s"}]
    back = readers.read_chat_jsonl(spark, str(tmp_path / "chat")).select(*chat.columns)
    assert back.exceptAll(chat).count() == 0 and back.count() == 2


def test_scene_table_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("fire_1", "Fire", "a/b.JPG", "c.JPG", "d.TIFF", '{"fire_present": true, "fire_size": "x, \\"y\\""}', "test")],
        "scene_id string, category string, rgb_path string, thermal_path string, thermal_tiff_path string, label_json string, split string",
    )
    sinks.write_scene_table(rows.coalesce(1), str(tmp_path / "split"))
    back = readers.read_scene_table(spark, str(tmp_path / "split"))
    assert back.collect() == rows.collect()
    with open(next((tmp_path / "split").glob("*.csv"))) as f:
        assert next(csv.DictReader(f))["label_json"] == rows.first().label_json
    sinks.write_scene_table(rows.drop("split"), str(tmp_path / "labels"))
    assert readers.read_scene_table(spark, str(tmp_path / "labels"), split=False).first().label_json == rows.first().label_json


def test_nominals(spark):
    schema = "tag string, variable string, nominal_value string"
    sheets = {
        ("ug-1", "MT"): spark.createDataFrame(
            [(" FT 1 ", " Water ", "10.5"), (None, "x", "1"), ("  ", "x", "1"), ("nan", "x", "1"), ("T2", None, "-3"), (None, None, None), ("T3", "x", "n/a"), ("T5", "x", "1d"), ("T6", "x", "NaN"), ("T4", "x", None)],
            schema,
        ),
        ("ug-2", "BL1"): spark.createDataFrame([("FT 1", "Steam", "1e2")], schema),
    }
    got = {(r.equipment_id, r.regime, r.tag, r.variable, r.nominal_value) for r in process.load_nominals(sheets).collect()}
    assert got == {
        ("ug-1", "MT", "FT 1", "Water", 10.5),
        ("ug-1", "MT", "T2", "", -3.0),
        ("ug-2", "BL1", "FT 1", "Steam", 100.0),
    }


def test_run_files(spark, tmp_path):
    from plantwatch.operators import modelruns

    outputs = spark.createDataFrame([("s1", "a", '{"t": 1}', '{"t": 1}', 0.5)], "scene string, run string, raw string, truth string, latency_s double")
    scored = modelruns.score_fields(outputs, ["t"])
    sinks.write_run(scored, modelruns.run_summary(scored, ["t"]), str(tmp_path / "run"), {"model": "m1"})
    meta = spark.read.json(f"{tmp_path}/run/meta").first()
    assert (meta.overall, meta.model) == (1.0, "m1")
    assert {r.field: r.accuracy for r in spark.read.json(f"{tmp_path}/run/fields").collect()} == {"valid_json": 1.0, "fields_present": 1.0, "t": 1.0}
    assert spark.read.json(f"{tmp_path}/run/results").first().pred == '{"t":1}'


def test_landed_alerts_have_an_identity(spark, tmp_path):
    folder = tmp_path / "alerts" / "gw-1"
    folder.mkdir(parents=True)
    alert = {"equipment_id": "gw-1", "node_id": "a", "failure_mode": "TWF", "anomaly_score": 0.9, "severity": "critical", "resolved": 0}
    for k in range(2):
        (folder / f"170000000{k}000.json").write_text(json.dumps(alert))
    (folder / "copy").mkdir()
    rows = readers.read_landed(spark, str(tmp_path / "alerts"), "alerts")
    again = readers.read_landed(spark, str(tmp_path / "alerts"), "alerts")
    numbers = sorted(r.alert_id for r in rows.collect())
    assert len(set(numbers)) == 2 and numbers == sorted(r.alert_id for r in again.collect())
    assert set(lake_schema("alerts").names) == set(rows.columns)


def test_payload_schema_is_fixed():
    assert READING_PAYLOAD["reading_id"].dataType.simpleString() == "bigint"
    assert READING_TABLE.names[:4] == ["reading_id", "equipment_id", "equipment_type", "timestamp"]
