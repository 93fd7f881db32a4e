"""Breaches, context, interventions and the report procedures."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from plantwatch.functions.numbers import report_round
from plantwatch.functions.rules import MODES, PROBABILITIES, SENSOR_RANGES, SENSORS
from plantwatch.operators import episodes, fleet, knowledge
from plantwatch.plans import reports
from plantwatch.registry.book import register, rounded
from plantwatch.registry.fleet import ALERT_LIST, AVG_PROBS, COUNT, FAILURES, NODE, STATS, STATUS, first_mode, recent_sql
from plantwatch.registry.frames import BEST, SLOPE

R = rounded
BEFORE_S, AFTER_S = 6 * 3600, 3600
DAY = date(2024, 3, 1)


def six(df, *columns):
    for c in columns:
        df = df.withColumn(c, report_round(F.col(c), 6))
    return df


def values_sql(source: str, keep: str) -> str:
    """SQL: one row per row of `source` and sensor, with its limits."""
    return " UNION ALL ".join(
        f"""SELECT {keep}, {i} AS ordinal, '{name}' AS variable, CAST({name} AS DOUBLE) AS value, {lo}e0 AS low, {hi}e0 AS high
        FROM {source}"""
        for i, (name, (lo, hi)) in enumerate(SENSOR_RANGES.items())
    )


DEVIATION = """CASE WHEN value < low THEN (value - low) * 100e0 / nullif(abs(low), 0)
  WHEN value > high THEN (value - high) * 100e0 / nullif(abs(high), 0) ELSE 0 END"""

register("sensor_breaches", ["stressed"], f"""
, v AS ({values_sql('stressed', 'reading_id, node_id')})
SELECT reading_id, node_id, variable, value, low, high, {R(DEVIATION, 6)} AS deviation_pct FROM v
WHERE value < low OR value > high
""")(lambda s: six(episodes.sensor_breaches(s, ["reading_id", "node_id"]).drop("ordinal"), "deviation_pct"))

CONTEXT = f"""
, x AS (SELECT a.alert_id, r.*, CASE WHEN r.event_ts < a.event_ts THEN 'before' WHEN r.event_ts > a.event_ts THEN 'after'
    ELSE 'during' END AS phase
  FROM alerts a JOIN stressed r ON r.node_id = a.node_id AND r.event_ts >= a.event_ts - INTERVAL {BEFORE_S} SECOND
    AND r.event_ts <= a.event_ts + INTERVAL {AFTER_S} SECOND)
"""
register("alerts_with_context", ["alerts", "stressed"], CONTEXT + """
SELECT alert_id, reading_id, node_id, phase, anomaly_score FROM x
""")(
    lambda a, s: episodes.alerts_with_context(a, s, BEFORE_S, AFTER_S).select(
        "alert_id", "reading_id", "node_id", "phase", "anomaly_score"
    )
)

register("nodes_without_alerts", ["readings", "quiet_alerts"], """
SELECT DISTINCT node_id FROM readings r WHERE node_id <> ''
  AND NOT EXISTS (SELECT 1 FROM quiet_alerts a WHERE a.node_id = r.node_id AND resolved = 0)
""")(lambda r, a: reports.nodes_without_alerts(fleet.list_nodes(r).select("node_id").distinct(), a))

register("nodes_with_open_alerts", ["readings", "alerts"], """
SELECT DISTINCT node_id FROM readings r WHERE node_id <> ''
  AND EXISTS (SELECT 1 FROM alerts a WHERE a.node_id = r.node_id AND resolved = 0)
""")(lambda r, a: reports.nodes_with_open_alerts(fleet.list_nodes(r).select("node_id").distinct(), a))

LEADING = first_mode({m: f"avg_{p}" for m, p in zip(MODES, PROBABILITIES)})
PARTS = dict(knowledge.SPARE_PARTS)
STEPS = ", ".join(f"('{m}', {i}, '{step}', '{PARTS[m]}')" for m, i, step in knowledge.WORK_STEPS)
# The dominant mode and, within the tolerance, the next most likely one.
LIKELY = f"""steps AS (SELECT * FROM (VALUES {STEPS}) AS v(failure_mode, step_no, step, parts)),
long AS ({' UNION ALL '.join(f"SELECT node_id, node_name, equipment_id, '{m}' AS m, {i} AS o, avg_{p} AS p FROM o1" for i, (m, p) in enumerate(zip(MODES, PROBABILITIES)))}),
placed AS (SELECT *, row_number() OVER (PARTITION BY {NODE} ORDER BY p DESC, o) AS place,
    max(p) OVER (PARTITION BY {NODE}) AS top FROM long),
likely AS (SELECT *, place AS mode_rank, m AS failure_mode FROM placed WHERE place = 1 OR (place = 2 AND top - p <= 0.05e0))"""

register("attach_interventions", ["readings", "alerts"], f"""
, o1 AS ({STATS} WHERE node_id <> '' GROUP BY {NODE}), {LIKELY}
SELECT node_id, node_name, equipment_id, CAST(mode_rank AS INT) AS mode_rank, failure_mode, CAST(step_no AS INT) AS step_no, step, parts
FROM likely JOIN steps USING (failure_mode)
""")(
    lambda r, a: knowledge.attach_interventions(fleet.diagnostic(r, a)).select(
        "node_id", "node_name", "equipment_id", "mode_rank", "failure_mode", "step_no", "step", "parts"
    )
)

NAMES = "CASE {m} " + " ".join(f"WHEN '{m}' THEN '{n}'" for m, n in knowledge.MODE_NAMES.items()) + " END"
DIAGNOSED = f"""
, stats AS ({STATS} WHERE node_id <> '' GROUP BY {NODE}),
recent AS ({recent_sql("node_id")}),
dg AS (SELECT s.*, {STATUS} AS status, {LEADING} AS dominant_failure_mode, recent_avg_score, recent_failures
  FROM stats s LEFT JOIN recent USING (node_id))"""

register("executive_report_status", ["readings", "alerts"], DIAGNOSED + """
SELECT CASE max(CASE status WHEN 'CRÍTICO' THEN 2 WHEN 'ALERTA' THEN 1 ELSE 0 END) WHEN 2 THEN 'CRÍTICO' WHEN 1 THEN 'ALERTA'
  ELSE 'NORMAL' END AS status FROM dg
""")(lambda r, a: reports.executive_status(r, a))

register("executive_report_attention", ["readings", "alerts"], DIAGNOSED + f"""
, al AS (SELECT node_id, count(DISTINCT failure_mode || severity) AS g FROM alerts GROUP BY node_id),
rk AS (SELECT {NODE}, CAST(SUM(CASE WHEN anomaly_score >= 0.65 THEN 1 ELSE 0 END) AS BIGINT) AS readings_in_alert,
  {R('100e0 * SUM(CASE WHEN anomaly_score >= 0.65 THEN 1 ELSE 0 END) / COUNT(*)', 1)} AS pct_in_alert
  FROM readings WHERE node_id <> '' GROUP BY {NODE})
SELECT node_id, node_name, equipment_id, avg_score, readings_in_alert, pct_in_alert, status, dominant_failure_mode AS failure_mode,
  recent_avg_score, recent_failures, CAST(least(coalesce(g, 0), 10) AS INT) AS alert_groups, {NAMES.format(m='dominant_failure_mode')} AS mode_name
FROM dg JOIN rk USING (node_id, node_name, equipment_id) LEFT JOIN al USING (node_id)
ORDER BY avg_score DESC, {NODE} LIMIT 3
""")(lambda r, a: reports.executive_attention(r, a))

register("executive_report_critical", ["readings", "alerts"], f"""
SELECT {ALERT_LIST}, {NAMES.format(m='failure_mode')} AS mode_name FROM alerts WHERE resolved = 0 AND severity = 'critical'
ORDER BY anomaly_score DESC, event_ts DESC, alert_id DESC LIMIT 10
""")(lambda r, a: reports.executive_critical(a))

register("executive_report_fallback", ["readings", "alerts"], f"""
, e AS (SELECT equipment_id, {COUNT} AS total_readings, {R('AVG(anomaly_score)', 4)} AS avg_anomaly_score,
  {FAILURES} AS total_failures, {AVG_PROBS} FROM readings GROUP BY equipment_id)
SELECT *, {STATUS.replace('avg_score', 'avg_anomaly_score')} AS status FROM e
""")(lambda r, a: reports.executive_fallback(r))

ORDERS = DIAGNOSED + SLOPE + f"""
, br AS (SELECT node_id, string_agg(DISTINCT variable, ', ' ORDER BY variable) AS breached
  FROM ({values_sql('readings', 'node_id')}) WHERE value < low OR value > high GROUP BY node_id),
un AS (SELECT dg.*, slope, first_score, last_score, coalesce(breached, '') AS breached,
    CASE WHEN status = 'CRÍTICO' OR slope >= 0.005e0 THEN 'hours' WHEN slope >= 0.0005e0 OR status = 'ALERTA' THEN 'days'
    ELSE 'planned' END AS urgency
  FROM dg JOIN s USING (node_id) LEFT JOIN br USING (node_id)),
o1 AS (SELECT *, row_number() OVER (ORDER BY avg_score DESC, {NODE}) AS number FROM un
  WHERE avg_score >= 0.65 OR recent_avg_score >= 0.65 OR urgency <> 'planned')
"""
register("work_orders", ["readings", "alerts"], ORDERS + f"""
, {LIKELY}
SELECT 'OT-20240301-' || lpad(CAST(number AS STRING), 3, '0') AS folio, node_id, node_name, equipment_id, status, dominant_failure_mode,
  avg_score, first_score, last_score, slope, breached, urgency,
  CASE urgency WHEN 'hours' THEN 'high' WHEN 'days' THEN 'medium' ELSE 'low' END AS priority,
  CAST(mode_rank AS INT) AS mode_rank, failure_mode, CAST(step_no AS INT) AS step_no, step, parts
FROM o1 JOIN likely USING (node_id, node_name, equipment_id) JOIN steps USING (failure_mode)
""")(
    lambda r, a: six(
        reports.work_orders(r, a, DAY).drop("issued", *[f"avg_{p}" for p in PROBABILITIES]), "slope"
    )
)

CAUSE_TIMELINE = CONTEXT + """
, p AS (SELECT *, lag(anomaly_score) OVER k AS prev, row_number() OVER k AS pos FROM x
  WINDOW k AS (PARTITION BY alert_id ORDER BY event_ts, reading_id)),
t AS (SELECT *, max(CASE WHEN prev IS NULL OR anomaly_score <= prev THEN pos END) OVER (PARTITION BY alert_id
  ORDER BY pos) AS turn FROM p),
c AS (SELECT alert_id, min(pos) AS cross_pos FROM t WHERE anomaly_score >= 0.65 AND (prev < 0.65 OR prev IS NULL) GROUP BY alert_id),
g AS (SELECT alert_id, CAST(count(*) AS BIGINT) AS readings, arg_min(anomaly_score, pos) AS base_score,
  max(anomaly_score) AS peak_score FROM t GROUP BY alert_id)
SELECT g.alert_id, readings, base_score, y.reading_id AS crossing_reading, CAST(cross_pos - y.turn AS BIGINT) AS rise_rows,
  peak_score, CASE WHEN cross_pos - y.turn <= 3 THEN 'abrupt' WHEN cross_pos IS NOT NULL THEN 'gradual' END AS rise
FROM g LEFT JOIN c USING (alert_id) LEFT JOIN t y ON y.alert_id = c.alert_id AND y.pos = c.cross_pos
"""


def context(alert_rows, readings, first=None, paired=True):
    return episodes.alerts_with_context(alert_rows, readings, BEFORE_S, AFTER_S, first=first, paired=paired)


def first_breaches(alert_rows, readings):
    """The context as far as the trigger goes: the first reading with a breach around each alert."""
    return context(alert_rows, readings.select("node_id", *reports.READING_ORDER, *SENSOR_RANGES), episodes.any_breach())


register("root_cause_timeline", ["alerts", "stressed"], CAUSE_TIMELINE)(
    lambda a, s: reports.cause_timeline(context(a, s, paired=False)).select(
        "alert_id",
        "readings",
        "base_score",
        F.col("crossing.reading_id").alias("crossing_reading"),
        "rise_rows",
        "peak_score",
        "rise",
    )
)

FIRST = f"""
, v AS ({values_sql("(SELECT * FROM x WHERE phase <> 'after')", 'alert_id, event_ts, reading_id')}),
fb AS (SELECT alert_id, variable AS trigger_variable FROM (SELECT *, row_number() OVER (PARTITION BY alert_id
    ORDER BY event_ts, reading_id, ordinal) AS rn FROM v WHERE value < low OR value > high) WHERE rn = 1)
"""
register("root_cause_deviations", ["alerts", "stressed"], CONTEXT + FIRST + f"""
, av AS ({values_sql('alerts', 'alert_id')})
SELECT av.alert_id, CAST(ordinal AS INT) AS ordinal, variable, value, low, high, {R(DEVIATION, 6)} AS deviation_pct,
  coalesce(variable = trigger_variable, false) AS "trigger" FROM av LEFT JOIN fb USING (alert_id)
""")(lambda a, s: six(reports.cause_deviations(a, first_breaches(a, s)), "deviation_pct"))

_names = " || ".join(
    f"CASE WHEN {s} < {lo}e0 OR {s} > {hi}e0 THEN '{s} ' ELSE '' END" for s, (lo, hi) in sorted(SENSOR_RANGES.items())
)
register("root_cause_together", ["alerts", "stressed"], CONTEXT + f"""
, n AS (SELECT alert_id, trim({_names}) AS variables FROM x)
SELECT alert_id, variables, CAST(count(*) AS BIGINT) AS readings FROM n WHERE contains(variables, ' ') GROUP BY ALL
""")(lambda a, s: episodes.co_moving(context(a, s), ["alert_id"]).withColumn("variables", F.array_join("variables", " ")))

register("root_cause_verdict", ["alerts", "stressed"], CONTEXT + FIRST + f"""
, q AS (SELECT alert_id, node_id, failure_mode, severity,
    CASE WHEN tool_wear_min > 200 THEN 'TWF ' ELSE '' END ||
    CASE WHEN round(process_temp_k - air_temp_k, 6) < 8.6e0 AND rpm < 1380 THEN 'HDF ' ELSE '' END ||
    CASE WHEN NOT (torque_nm * rpm * (2 * 3.141592653589793e0) / 60e0 BETWEEN 3500 AND 9000) THEN 'PWF ' ELSE '' END ||
    CASE WHEN tool_wear_min * torque_nm > 11000 THEN 'OSF ' ELSE '' END AS shown,
    {' OR '.join(f'{s} < {SENSOR_RANGES[s][0]}e0 OR {s} > {SENSOR_RANGES[s][1]}e0' for s in SENSORS)} AS breached FROM alerts)
SELECT q.alert_id, node_id, failure_mode, severity, trim(shown) AS shown_modes, trigger_variable AS "trigger",
  CASE WHEN contains(shown, failure_mode) THEN 'signature confirmed' WHEN shown <> '' THEN 'other mode'
    WHEN NOT breached AND trigger_variable IS NULL THEN 'no sensor out of range: sensor noise'
    ELSE 'out of range without a signature' END AS verdict
FROM q LEFT JOIN fb ON fb.alert_id = q.alert_id
""")(lambda a, s: reports.cause_verdict(a, first_breaches(a, s)).withColumn("shown_modes", F.array_join("shown_modes", " ")))

register("training_report", ["epochs"], BEST + f"""
, x AS (SELECT run_id, min(grad_norm) FILTER (loss IS NOT NULL) AS min_grad_norm, max(grad_norm) FILTER (loss IS NOT NULL) AS max_grad_norm,
  arg_min(eval_loss, epoch) FILTER (eval_loss IS NOT NULL) AS first_eval_loss,
  arg_max(eval_loss, epoch) FILTER (eval_loss IS NOT NULL) AS last_eval_loss FROM epochs GROUP BY run_id)
SELECT r.run_id, best_epoch, best_metric, stop_epoch, min_grad_norm, max_grad_norm,
  first_eval_loss, last_eval_loss, {R('first_eval_loss / last_eval_loss', 6)} AS eval_loss_ratio
FROM r JOIN x USING (run_id)
""")(lambda e: six(reports.training_report(e), "eval_loss_ratio"))
