"""The nine analytics calls, filters and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch.functions.rules import MODES, PROBABILITIES, SENSORS
from plantwatch.operators import filters, fleet
from plantwatch.registry.book import register, rounded

R = rounded
PROBS = ", ".join(PROBABILITIES)
SENSOR_LIST = ", ".join(SENSORS)
READING_LIST = (
    f"reading_id, equipment_id, node_id, node_name, {SENSOR_LIST}, anomaly_score, predicted_failure, {PROBS}"
)
ALERT_LIST = (
    "equipment_id, node_id, node_name, failure_mode, probability, severity, anomaly_score, "
    f"{SENSOR_LIST}, resolved"
)
NODE = "node_id, node_name, equipment_id"
AVG_PROBS = ", ".join(f"{R(f'AVG({p})', 4)} AS avg_{p}" for p in PROBABILITIES)
AVG_SENSORS = ", ".join(f"{R(f'AVG({s})', d)} AS avg_{s}" for s, d in zip(SENSORS, (2, 2, 0, 2, 1)))
COUNT = "CAST(COUNT(*) AS BIGINT)"
FAILURES = "CAST(SUM(predicted_failure) AS BIGINT)"


def first_mode(values: dict[str, str]) -> str:
    """SQL: the first mode whose value is the largest."""
    top = f"GREATEST({', '.join(values.values())})"
    cases = " ".join(f"WHEN {v} = {top} THEN '{m}'" for m, v in values.items())
    return f"CASE {cases} END"


register("optional_equals", ["readings"], """
SELECT * FROM readings WHERE equipment_id = 'gw-1' AND product_type = 'M'
""")(lambda r: filters.optional_equals(r, equipment_id="gw-1", node_id="", product_type="M", node_name=None))

register("has_node", ["readings"], "SELECT reading_id, node_id FROM readings WHERE node_id <> ''")(
    lambda r: filters.has_node(r).select("reading_id", "node_id")
)

register("anomalies_only", ["process_readings"], """
SELECT reading_id, tag, regime, is_anomaly FROM process_readings WHERE is_anomaly = 1
""")(lambda p: filters.anomalies_only(p).select("reading_id", "tag", "regime", "is_anomaly"))

register("deviation_over", ["process_readings"], """
SELECT reading_id, tag, regime, deviation_pct FROM process_readings WHERE abs(deviation_pct) > 15
""")(lambda p: filters.deviation_over(p, 15).select("reading_id", "tag", "regime", "deviation_pct"))

register("normal_only", ["readings"], "SELECT reading_id FROM readings WHERE machine_failure = 0")(
    lambda r: filters.normal_only(r).select("reading_id")
)

register("open_alerts", ["alerts"], f"""
SELECT {ALERT_LIST} FROM alerts WHERE resolved = 0 AND severity = 'critical'
""")(lambda a: filters.alert_columns(filters.open_alerts(a, "critical")))

register("reading_columns", ["readings"], f"SELECT {READING_LIST} FROM readings")(filters.reading_columns)

register("alert_columns", ["alerts"], f"SELECT {ALERT_LIST} FROM alerts")(filters.alert_columns)

TREND_LIST = f"""reading_id, node_name, {R('anomaly_score', 4)} AS anomaly_score, predicted_failure,
  {R('air_temp_k', 2)} AS air_temp_k, {R('process_temp_k', 2)} AS process_temp_k, rpm,
  {R('torque_nm', 2)} AS torque_nm, tool_wear_min"""
register("trend_columns", ["readings"], f"SELECT {TREND_LIST} FROM readings")(filters.trend_columns)

PROCESS_LIST = f"""equipment_id, tag, variable, variable_medicion, {R('value', 3)} AS value, unit, regime,
  {R('nominal_value', 3)} AS nominal_value, {R('deviation_pct', 2)} AS deviation_pct, is_anomaly, desde, hasta,
  timestamp"""
register("process_columns", ["process_readings"], f"SELECT {PROCESS_LIST} FROM process_readings")(
    filters.process_columns
)

register("sensor_readings", ["readings"], f"""
SELECT {READING_LIST} FROM readings ORDER BY event_ts DESC, reading_id DESC, equipment_id, node_id LIMIT 500
""")(lambda r: fleet.sensor_readings(r, limit=500))

register("sensor_readings_of_equipment", ["readings"], f"""
SELECT {READING_LIST} FROM readings WHERE equipment_id = 'gw-2' ORDER BY event_ts DESC, reading_id DESC LIMIT 20
""")(lambda r: fleet.sensor_readings(r, equipment_id="gw-2"))

register("alerts", ["alerts"], f"""
SELECT {ALERT_LIST} FROM alerts ORDER BY anomaly_score DESC, event_ts DESC, alert_id DESC LIMIT 100
""")(lambda a: fleet.alerts(a, limit=100))

register("alerts_by_severity", ["alerts"], f"""
SELECT {ALERT_LIST} FROM alerts WHERE severity = 'high'
ORDER BY anomaly_score DESC, event_ts DESC, alert_id DESC LIMIT 20
""")(lambda a: fleet.alerts(a, severity="high"))

register("list_nodes", ["readings"], f"""
SELECT {NODE}, {COUNT} AS total_readings, {R('AVG(anomaly_score)', 4)} AS avg_anomaly_score,
  {FAILURES} AS total_failures, {R('MAX(anomaly_score)', 4)} AS max_anomaly_score
FROM readings WHERE node_id <> '' GROUP BY {NODE}
""")(fleet.list_nodes)

register("equipment_summary", ["readings"], f"""
SELECT equipment_id, {COUNT} AS total_readings, {R('AVG(anomaly_score)', 4)} AS avg_anomaly_score,
  {FAILURES} AS total_failures, {AVG_PROBS}
FROM readings GROUP BY equipment_id
""")(fleet.equipment_summary)

register("node_trend", ["readings"], f"""
SELECT {TREND_LIST} FROM (SELECT * FROM readings WHERE node_id = 'node-003' ORDER BY event_ts DESC, reading_id DESC LIMIT 50)
""")(lambda r: fleet.node_trend(r, "node-003"))

TOP_RISK = f"""
SELECT {NODE}, {COUNT} AS total_readings, {R('AVG(anomaly_score)', 4)} AS avg_score,
  {R('MAX(anomaly_score)', 4)} AS max_score, {FAILURES} AS total_failures,
  CAST(SUM(CASE WHEN anomaly_score >= 0.65 THEN 1 ELSE 0 END) AS BIGINT) AS readings_in_alert,
  {R('100e0 * SUM(CASE WHEN anomaly_score >= 0.65 THEN 1 ELSE 0 END) / COUNT(*)', 1)} AS pct_in_alert
FROM readings WHERE node_id <> '' GROUP BY {NODE}
ORDER BY avg_score DESC, {NODE} LIMIT
"""
register("top_risk", ["readings"], f"{TOP_RISK} 5")(fleet.top_risk)
register("top_risk_wide", ["readings"], f"{TOP_RISK} 20")(lambda r: fleet.top_risk(r, limit=20))

register("failure_heatmap", ["readings"], f"""
, a AS (SELECT node_name, {', '.join(f'AVG({p}) AS {p}' for p in PROBABILITIES)},
    {R('AVG(anomaly_score)', 4)} AS avg_anomaly_score
  FROM readings WHERE node_id <> '' GROUP BY node_name)
SELECT node_name, {', '.join(f'{R(p, 4)} AS {p}' for p in PROBABILITIES)}, avg_anomaly_score,
  {first_mode(dict(zip(MODES, PROBABILITIES)))} AS dominant_failure_mode
FROM a
""")(fleet.failure_heatmap)

STATS = f"""SELECT {NODE}, {COUNT} AS total_readings, {R('AVG(anomaly_score)', 4)} AS avg_score,
  {R('MAX(anomaly_score)', 4)} AS max_score, {FAILURES} AS total_failures, {AVG_PROBS}, {AVG_SENSORS}
FROM readings"""
register("node_stats", ["readings"], f"{STATS} GROUP BY {NODE}")(fleet.node_stats)


def recent_sql(by: str, source: str = "readings") -> str:
    return f"""SELECT {by}, {R('AVG(anomaly_score)', 4)} AS recent_avg_score, {FAILURES} AS recent_failures
FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY event_ts DESC, reading_id DESC) AS rn FROM {source})
WHERE rn <= 20 GROUP BY {by}"""


def breakdown_sql(by: str) -> str:
    groups = f"""SELECT {by}, failure_mode, severity, {COUNT} AS "count", {R('MAX(anomaly_score)', 4)} AS max_score
  FROM alerts GROUP BY {by}, failure_mode, severity"""
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY max_score DESC, failure_mode, severity)
  AS INT) AS "rank" FROM ({groups})) WHERE "rank" <= 10"""


STATUS = """CASE WHEN avg_score >= 0.80 THEN 'CRÍTICO' WHEN avg_score >= 0.65 THEN 'ALERTA' ELSE 'NORMAL' END"""


def diagnostic_sql(by: str) -> str:
    return f"""
, stats AS ({STATS} WHERE {by} <> '' GROUP BY {NODE}),
recent AS ({recent_sql(by)}),
listed AS (SELECT {by}, string_agg(failure_mode || '/' || severity || '/' || CAST("count" AS STRING), ' '
    ORDER BY "rank") AS recent_alerts FROM ({breakdown_sql(by)}) GROUP BY {by})
SELECT s.*, {STATUS} AS status, {first_mode({m: f'avg_{p}' for m, p in zip(MODES, PROBABILITIES)})}
  AS dominant_failure_mode, recent_avg_score, recent_failures, coalesce(recent_alerts, '') AS recent_alerts
FROM stats s LEFT JOIN recent USING ({by}) LEFT JOIN listed USING ({by})
"""


register("recent_stats", ["readings"], recent_sql("node_id"))(fleet.recent_stats)

# Readings whose number starts over twice, as after a restart of the gateway.
RESTARTED = ", again AS (SELECT * REPLACE (reading_id % 400 AS reading_id) FROM readings)"
register("recent_stats_after_restart", ["readings"], f"{RESTARTED} {recent_sql('node_id', 'again')}")(
    lambda r: fleet.recent_stats(r.withColumn("reading_id", F.col("reading_id") % 400))
)

register("alert_breakdown", ["alerts"], breakdown_sql("node_id"))(fleet.alert_breakdown)


def alerts_as_text(diagnosed):
    shown = F.transform(
        "recent_alerts",
        lambda a: F.concat_ws("/", a["failure_mode"], a["severity"], a["count"].cast("string")),
    )
    return diagnosed.withColumn("recent_alerts", F.array_join(shown, " "))


register("diagnostic", ["readings", "alerts"], diagnostic_sql("node_id"))(
    lambda r, a: alerts_as_text(fleet.diagnostic(r, a))
)

register("diagnostic_by_equipment", ["readings", "alerts"], diagnostic_sql("equipment_id"))(
    lambda r, a: alerts_as_text(fleet.diagnostic(r, a, by="equipment_id"))
)

register("process_readings", ["process_readings"], f"""
SELECT {PROCESS_LIST} FROM process_readings
ORDER BY timestamp DESC, equipment_id, tag, regime, reading_id, value LIMIT 100
""")(lambda p: fleet.process_readings(p, limit=100))

register("process_anomalies", ["process_readings"], f"""
SELECT {PROCESS_LIST} FROM process_readings WHERE is_anomaly = 1 AND regime = 'BL1'
ORDER BY timestamp DESC, equipment_id, tag, regime, reading_id, value LIMIT 20
""")(lambda p: fleet.process_readings(p, regime="BL1", anomaly_only=True))

register("top_k", ["alerts"], """
SELECT alert_id, node_id, anomaly_score FROM alerts ORDER BY anomaly_score DESC, alert_id LIMIT 25
""")(lambda a: fleet.top_k(a.select("alert_id", "node_id", "anomaly_score"), [F.desc("anomaly_score"), "alert_id"], 25))

register("top_k_per_key", ["alerts"], """
SELECT * FROM (SELECT node_name, alert_id, anomaly_score, CAST(row_number() OVER (
  PARTITION BY node_name ORDER BY anomaly_score DESC, alert_id) AS INT) AS "rank" FROM alerts) WHERE "rank" <= 3
""")(
    lambda a: fleet.top_k_per_key(
        a.select("node_name", "alert_id", "anomaly_score"), ["node_name"], [F.desc("anomaly_score"), "alert_id"], 3
    )
)
