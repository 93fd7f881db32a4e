"""Reports on small hand-made plants, and the training log."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantwatch.operators import episodes, fleet, knowledge
from plantwatch.plans import reports
from plantwatch.registry import QUERIES

SMOKE_DIR = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)
NORMAL = dict(air_temp_k=300.0, process_temp_k=310.0, rpm=1500, torque_nm=40.0, tool_wear_min=50)
SCHEMA = (
    "reading_id long, event_ts timestamp, equipment_id string, node_id string, node_name string, air_temp_k double, "
    "process_temp_k double, rpm int, torque_nm double, tool_wear_min int, prob_twf double, prob_hdf double, "
    "prob_pwf double, prob_osf double, prob_rnf double, anomaly_score double, predicted_failure int"
)
ALERTS = (
    "alert_id long, event_ts timestamp, equipment_id string, node_id string, node_name string, failure_mode string, "
    "probability double, severity string, anomaly_score double, air_temp_k double, process_temp_k double, rpm int, "
    "torque_nm double, tool_wear_min int, resolved int"
)


def reading(i, node, probs, **sensors):
    values = {**NORMAL, **sensors}
    score = max(probs)
    return (i, START + timedelta(seconds=5 * i), "gw", node, f"Unit {node}", *values.values(), *probs, score, int(score >= 0.5))


def alert(i, node, mode, score, resolved=0, severity="critical", **sensors):
    return (i, START + timedelta(seconds=5 * i), "gw", node, f"Unit {node}", mode, score, severity, score, *{**NORMAL, **sensors}.values(), resolved)


@pytest.fixture(scope="module")
def plant(spark):
    rows = [reading(i, "a", (0.9, 0.1, 0.1, 0.1, 0.1), tool_wear_min=230) for i in range(30)]
    rows += [reading(i, "b", (0.1, 0.68, 0.66, 0.1, 0.1)) for i in range(30)]
    rows += [reading(i, "c", (0.1, 0.1, 0.1, 0.1 + i * 0.002, 0.1)) for i in range(60)]
    rows += [reading(i, "d", (0.2, 0.1, 0.1, 0.1, 0.1)) for i in range(30)]
    rows += [reading(i, node, (0.99, 0.0, 0.0, 0.0, 0.0)) for node in ("", None) for i in range(5)]
    alerts = [alert(1, "a", "TWF", 0.95, tool_wear_min=230), alert(2, "a", "TWF", 0.93, resolved=1), alert(3, "b", "HDF", 0.68, severity="medium")]
    return spark.createDataFrame(rows, SCHEMA).cache(), spark.createDataFrame(alerts, ALERTS).cache()


def test_diagnostic(plant):
    got = {r.node_id: r for r in fleet.diagnostic(*plant).collect()}
    assert {n: (r.status, r.dominant_failure_mode) for n, r in got.items()} == {
        "a": ("CRÍTICO", "TWF"), "b": ("ALERTA", "HDF"), "c": ("NORMAL", "OSF"), "d": ("NORMAL", "TWF"),
    }
    assert [(x.failure_mode, x["count"]) for x in got["a"].recent_alerts] == [("TWF", 2)]
    assert got["d"].recent_alerts == [] and got["c"].recent_avg_score > got["c"].avg_score


def test_diagnostic_of_unknown_node(plant):
    got = {r.node_id: r for r in fleet.diagnostic(*plant, values=["a", "zz"]).collect()}
    assert set(got) == {"a", "zz"}
    assert (got["zz"].status, got["zz"].dominant_failure_mode, got["zz"].recent_alerts) == ("SIN DATOS", "N/A", [])
    with pytest.raises(ValueError):
        fleet.diagnostic(*plant, by="node_name")


def test_diagnostic_by_equipment(plant):
    got = fleet.diagnostic(*plant, by="equipment_id").collect()
    assert {r.node_id for r in got} == {"a", "b", "c", "d", "", None}
    assert len({r.recent_avg_score for r in got}) == 1


def test_limits(plant):
    assert fleet.sensor_readings(plant[0], limit=1000).count() == 160
    assert fleet.top_risk(plant[0], limit=500).count() == 4
    assert fleet.sensor_readings(plant[0], limit=0).count() == 0
    with pytest.raises(ValueError):
        fleet.sensor_readings(plant[0], limit=-1)
    with pytest.raises(ValueError):
        fleet.node_trend(plant[0], "")
    trend = [r.reading_id for r in fleet.node_trend(plant[0], "c", 10).collect()]
    assert trend == list(range(50, 60))


def test_recent_readings_follow_time_when_numbers_restart(spark):
    old = [reading(i, "a", (0.1,) * 5) for i in range(30)]
    new = [(i, START + timedelta(days=1, seconds=i), *reading(i, "a", (0.9,) * 5)[2:]) for i in range(10)]
    readings = spark.createDataFrame(old + new, SCHEMA)
    got = fleet.recent_stats(readings).first()
    assert (got.recent_avg_score, got.recent_failures) == (0.5, 10)
    assert fleet.sensor_readings(readings, limit=1).first().anomaly_score == 0.9
    assert [r.anomaly_score for r in fleet.node_trend(readings, "a", 11).collect()] == [0.1] + [0.9] * 10


def test_interventions_of_the_caller(spark, plant):
    steps = spark.createDataFrame([("TWF", 1, "own step"), ("OSF", 1, "x")], "failure_mode string, step_no int, step string")
    parts = spark.createDataFrame([("TWF", "own part")], "failure_mode string, parts string")
    got = knowledge.attach_interventions(fleet.diagnostic(*plant), steps, parts).collect()
    assert {(r.node_id, r.step, r.parts) for r in got} == {("a", "own step", "own part"), ("d", "own step", "own part"), ("c", "x", None)}


def test_filters_are_values_not_text(plant):
    assert fleet.sensor_readings(plant[0], node_id="a' OR '1'='1").count() == 0


def test_executive_report(plant):
    got = reports.executive_report(*plant)
    assert got["status"].first().status == "CRÍTICO"
    first = got["attention"].orderBy(F.desc("avg_score")).collect()
    assert [r.node_id for r in first] == ["a", "b", "d"]
    assert first[0].mode_name == knowledge.MODE_NAMES["TWF"]
    assert [r.node_id for r in got["critical_alerts"].collect()] == ["a"]
    assert got["fallback"].first().equipment_id == "gw"


def test_nodes_by_alert(plant):
    readings, alerts = plant
    nodes = fleet.list_nodes(readings).select("node_id")
    assert {r.node_id for r in reports.nodes_with_open_alerts(nodes, alerts).collect()} == {"a", "b"}
    assert {r.node_id for r in reports.nodes_without_alerts(nodes, alerts).collect()} == {"c", "d"}


def test_work_orders(plant):
    orders = reports.work_orders(*plant, date(2024, 3, 1), steps=False).orderBy("folio").collect()
    assert [(r.folio, r.node_id, r.urgency, r.priority) for r in orders] == [
        ("OT-20240301-001", "a", "hours", "high"),
        ("OT-20240301-002", "b", "days", "medium"),
        ("OT-20240301-003", "c", "days", "medium"),
    ]
    steps = reports.work_orders(*plant, date(2024, 3, 1)).collect()
    assert {(r.node_id, r.mode_rank, r.failure_mode) for r in steps} == {
        ("a", 1, "TWF"), ("b", 1, "HDF"), ("b", 2, "PWF"), ("c", 1, "OSF"),
    }
    assert [r.step_no for r in sorted(steps, key=lambda r: r.step_no) if r.node_id == "a"] == [1, 2]


def test_context_span(spark, plant):
    readings = plant[0].filter("node_id = 'c'")
    alerts = spark.createDataFrame([alert(30, "c", "OSF", 0.7)], ALERTS)
    got = episodes.alerts_with_context(alerts, readings, 25, 10)
    assert sorted((r.reading_id, r.phase) for r in got.collect()) == [
        *[(i, "before") for i in range(25, 30)], (30, "during"), (31, "after"), (32, "after"),
    ]


def test_context_equals_brute_force(spark):
    rows = [reading(i * 7 % 400, "hot" if i % 3 else "cold", (0.1,) * 5) for i in range(400)]
    alerts = [alert(i, "hot", "TWF", 0.9) for i in range(0, 400, 17)]
    sides = spark.createDataFrame(alerts, ALERTS), spark.createDataFrame(rows, SCHEMA)
    got = episodes.alerts_with_context(*sides, 100, 35)
    expected = sorted(
        (a[0], r[0]) for a in alerts for r in rows
        if r[3] == a[3] and timedelta(seconds=-100) <= r[1] - a[1] <= timedelta(seconds=35)
    )
    assert sorted((r.alert_id, r.reading_id) for r in got.collect()) == expected
    sliced = episodes.alerts_with_context(*sides, 100, 35, rows_per_slice=23)
    assert sorted((r.alert_id, r.reading_id) for r in sliced.collect()) == expected and sliced.columns == got.columns


def test_context_is_the_same_for_any_number_of_buckets(spark, monkeypatch):
    rows = [reading(i, "hot", (0.1,) * 5) for i in range(90)]
    sides = spark.createDataFrame([alert(i, "hot", "TWF", 0.9) for i in range(0, 90, 11)], ALERTS), spark.createDataFrame(rows, SCHEMA)
    found = []
    for buckets in (1, episodes.BUCKETS, 50):
        monkeypatch.setattr(episodes, "BUCKETS", buckets)
        found.append(sorted((r.alert_id, r.reading_id) for r in episodes.alerts_with_context(*sides, 40, 25).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 90


def test_first_of_context_equals_brute_force_and_makes_no_pairs(spark):
    rows = [reading(i * 7 % 400, "hot" if i % 3 else "cold", (0.1,) * 5, tool_wear_min=300 if i % 5 == 0 else 50) for i in range(400)]
    rows += [reading(i, None, (0.1,) * 5, tool_wear_min=300) for i in range(0, 400, 9)] + rows[:40]
    alerts = [alert(i, node, "TWF", 0.9) for i in range(0, 400, 17) for node in ("hot", None)] + [alert(390, "cold", "TWF", 0.9)] * 2
    sides = spark.createDataFrame(alerts, ALERTS), spark.createDataFrame(rows, SCHEMA)
    pairs = sorted(
        (a[0], r[1], r[0], "before" if r[1] < a[1] else "after" if r[1] > a[1] else "during") for a in alerts for r in rows
        if r[3] == a[3] and r[3] and r[9] == 300 and timedelta(seconds=-100) <= r[1] - a[1] <= timedelta(seconds=35)
    )
    expected = {}
    for a, _, r, phase in pairs:
        expected.setdefault(a, (r, phase))
    whole = episodes.alerts_with_context(*sides, 100, 35)
    for size in (23, 1_000_000):
        got = episodes.alerts_with_context(*sides, 100, 35, rows_per_slice=size, first=episodes.any_breach())
        assert {r.alert_id: (r.reading_id, r.phase) for r in got.collect()} == expected and got.count() == len(expected) + (390 in expected)
        assert got.dtypes == whole.dtypes and "Join" not in got._jdf.queryExecution().optimizedPlan().toString().replace("JoinKeys", "")


def test_timeline_of_spans_equals_that_of_pairs(spark):
    def probs(i):
        return (0.1,) * 4 + ([0.2, 0.5, 0.7, 0.9, 0.65, 0.9, 0.3][(i * i + i // 3) % 7],)

    rows = [reading(i * 7 % 400, "hot" if i % 3 else "cold", probs(i)) for i in range(400)] + [reading(500, "far", probs(2))]
    rows = [(*r[:-2], None, r[-1]) if r[0] % 31 == 0 else r for r in rows] + [reading(i, None, probs(i)) for i in range(9)]
    rows += rows[:40]
    alerts = [alert(i, "hot", "TWF", 0.9) for i in range(0, 480, 17)] + [alert(390, "cold", "TWF", 0.9)] * 3 + [alert(1, None, "TWF", 0.9)]
    # One number for several spans or nodes, no number, no time, a span without readings.
    alerts += [alert(203, "cold", "TWF", 0.9), (52, START, *alert(52, "hot", "TWF", 0.9)[2:]), (53, None, *alert(53, "hot", "TWF", 0.9)[2:])]
    alerts += [(None, *alert(i, "hot", "TWF", 0.9)[1:]) for i in (60, 90)] + [alert(52, "hot", "TWF", 0.9), alert(900, "hot", "TWF", 0.9)]
    sides = spark.createDataFrame(alerts, ALERTS), spark.createDataFrame(rows, SCHEMA)
    pairs = reports.cause_timeline(episodes.alerts_with_context(*sides, 100, 35))
    expected = sorted(pairs.collect(), key=str)
    assert len(expected) > 25 and {r.rise_rows for r in expected} >= {0, 1}
    for size in (23, 1_000_000):
        spans = episodes.alerts_with_context(*sides, 100, 35, rows_per_slice=size, paired=False)
        got = reports.cause_timeline(spans, rows_per_slice=size)
        assert sorted(got.collect(), key=str) == expected and got.dtypes == pairs.dtypes


def test_queries_for_the_trigger_make_no_pairs(spark):
    for name in ("root_cause_deviations", "root_cause_verdict"):
        plan = QUERIES[name](spark, SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode(sequence" not in plan


def test_the_timeline_query_makes_no_pairs(spark, monkeypatch):
    made = []
    monkeypatch.setattr(episodes.Spans, "pairs", lambda self, alerts: made.append(alerts))
    plan = QUERIES["root_cause_timeline"](spark, SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert not made and "Join" not in plan.replace("JoinKeys", "")


def test_alerts_are_not_repeated_for_quiet_nodes(spark):
    rows = [reading(i, "n", (0.1,) * 5) for i in range(50)]
    got = episodes.alerts_with_context(spark.createDataFrame([alert(20, "n", "TWF", 0.9)], ALERTS), spark.createDataFrame(rows, SCHEMA), 30, 30)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "sequence" in plan and "salt" not in plan


def test_root_cause(spark):
    wear = [reading(i, "a", (min(0.1 + 0.02 * i, 0.95),) + (0.1,) * 4, tool_wear_min=200 + i * 2) for i in range(40)]
    quiet = [reading(i, "q", (0.1,) * 4 + (0.9 if i == 20 else 0.1,)) for i in range(40)]
    readings = spark.createDataFrame(wear + quiet, SCHEMA)
    alerts = spark.createDataFrame(
        [alert(30, "a", "TWF", 0.7, tool_wear_min=260), alert(31, "a", "PWF", 0.7, tool_wear_min=262), alert(20, "q", "RNF", 0.9)], ALERTS
    )
    got = reports.root_cause(alerts, readings, before_s=600, after_s=50)
    verdict = {r.alert_id: (r.verdict, r.trigger) for r in got["verdict"].collect()}
    assert verdict == {
        30: ("signature confirmed", "tool_wear_min"),
        31: ("other mode", "tool_wear_min"),
        20: ("no sensor out of range: sensor noise", None),
    }
    lines = {r.alert_id: r for r in got["timeline"].collect()}
    assert (lines[30].rise, lines[20].rise, lines[20].rise_rows) == ("gradual", "abrupt", 1)
    triggers = {(r.alert_id, r.variable) for r in got["deviations"].filter("trigger").collect()}
    assert triggers == {(30, "tool_wear_min"), (31, "tool_wear_min")}
    assert got["deviations"].count() == 15


# f1_macro per epoch: the best is the eighth of twenty.
HISTORY = [0.05, 0.06, 0.055, 0.07, 0.07, 0.075, 0.08, 0.0867, *[0.08, 0.0867, 0.07, 0.06] * 3]


def test_best_epoch(spark):
    log = [("r", i, m) for i, m in enumerate(HISTORY, 1)] + [("flat", i, 0.0) for i in range(1, 16)] + [("up", i, i / 10) for i in range(1, 6)]
    df = spark.createDataFrame(log, "run_id string, epoch int, f1_macro double")
    for rows in (3, 1000):
        got = {r.run_id: (r.best_epoch, r.stop_epoch) for r in episodes.best_epoch(df, "f1_macro", 12, rows_per_slice=rows).collect()}
        assert got == {"r": (8, 20), "flat": (None, 12), "up": (5, None)}


def test_rows_after_the_stop_do_not_count(spark):
    df = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.4), ("r", 3, 0.4), ("r", 4, 0.9)], "run_id string, epoch int, f1_macro double")
    got = episodes.best_epoch(df, "f1_macro", patience=2).first()
    assert (got.best_epoch, got.best_metric, got.stop_epoch) == (1, 0.5, 3)


def test_urgency(one):
    from plantwatch.operators.episodes import urgency

    cases = [(0.0, "NORMAL", "planned"), (0.001, "NORMAL", "days"), (0.01, "NORMAL", "hours"), (0.0, "CRÍTICO", "hours"), (-0.1, "ALERTA", "days"), (None, "NORMAL", "planned")]
    for slope, status, expected in cases:
        assert one({"s": slope, "t": status}, "s double, t string", urgency(F.col("s"), F.col("t"))) == expected


def test_a_value_that_is_no_number_breaches_nothing(spark):
    rows = [reading(1, "n", (0.1,) * 5, air_temp_k=float("nan")), reading(2, "n", (0.1,) * 5, air_temp_k=float("nan"), tool_wear_min=400)]
    readings = spark.createDataFrame(rows, SCHEMA)
    found = episodes.sensor_breaches(readings, ["reading_id"]).select("reading_id", "variable").collect()
    assert [tuple(r) for r in found] == [(2, "tool_wear_min")]
    values = episodes.sensor_values(readings, ["reading_id"]).filter("variable = 'air_temp_k'")
    assert [r.deviation_pct for r in values.collect()] == [None, None]
    first = episodes.first_breach(readings, ["node_id"], ["event_ts", "reading_id"]).first()
    assert (first.variable, first.reading_id) == ("tool_wear_min", 2)
    assert episodes.co_moving(readings, ["node_id"]).count() == 0
