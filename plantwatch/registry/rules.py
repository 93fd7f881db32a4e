"""Scalar rules over readings, scenes and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch.functions import jsontext, rules
from plantwatch.functions.numbers import report_round
from plantwatch.functions.rules import MODES, PROBABILITIES
from plantwatch.operators import filters, knowledge
from plantwatch.registry.book import register, rounded
from plantwatch.registry.fleet import first_mode
from plantwatch.streaming.alerts import alert_stream

R = rounded
BY_MODE = dict(zip(MODES, PROBABILITIES))
MODE_CASE = "CASE failure_mode " + " ".join(f"WHEN '{m}' THEN '{n}'" for m, n in knowledge.MODE_NAMES.items()) + " END"

register("severity", ["readings"], """
SELECT reading_id, CASE WHEN anomaly_score >= 0.9 THEN 'critical' WHEN anomaly_score >= 0.8 THEN 'high'
  WHEN anomaly_score >= 0.65 THEN 'medium' ELSE 'low' END AS severity FROM readings
""")(lambda r: r.select("reading_id", rules.severity(F.col("anomaly_score")).alias("severity")))

register("health_status", ["readings"], """
SELECT reading_id, CASE WHEN anomaly_score >= 0.8 THEN 'CRÍTICO' WHEN anomaly_score >= 0.65 THEN 'ALERTA'
  ELSE 'NORMAL' END AS status FROM readings
""")(lambda r: r.select("reading_id", rules.health_status(F.col("anomaly_score")).alias("status")))


def _dominant(readings):
    mode, probability = rules.dominant_mode(rules.mode_probabilities())
    return readings.select("reading_id", mode.alias("failure_mode"), probability.alias("probability"))


register("dominant_mode", ["readings"], f"""
SELECT reading_id, CASE WHEN greatest({', '.join(PROBABILITIES)}) <= 0 THEN 'MULTIPLE' ELSE {first_mode(BY_MODE)} END
  AS failure_mode, greatest(0e0, {', '.join(PROBABILITIES)}) AS probability FROM readings
""")(_dominant)

register("anomaly_score", ["readings"], f"""
SELECT reading_id, greatest({', '.join(PROBABILITIES)}) AS score,
  CAST(greatest({', '.join(PROBABILITIES)}) >= 0.5 AS INT) AS failing FROM readings
""")(
    lambda r: r.select(
        "reading_id", rules.anomaly_score([F.col(p) for p in PROBABILITIES]).alias("score")
    ).withColumn("failing", rules.predicted_failure(F.col("score")))
)

_band = "CASE WHEN {p} > 0.5 THEN 'alert' WHEN {p} > 0.25 THEN 'possible' ELSE 'normal' END"
register("probability_band", ["readings"], f"""
SELECT reading_id, {', '.join(f'{_band.format(p=p)} AS band_{m.lower()}' for m, p in BY_MODE.items())},
  greatest({', '.join(PROBABILITIES)}) > 0.25 AS anomaly FROM readings
""")(
    lambda r: r.select(
        "reading_id",
        *[rules.probability_band(F.col(p)).alias(f"band_{m.lower()}") for m, p in BY_MODE.items()],
        rules.any_possible([F.col(p) for p in PROBABILITIES]).alias("anomaly"),
    )
)

POWER = "torque_nm * rpm * (2 * 3.141592653589793e0) / 60e0"
register("derived_physics", ["readings"], f"""
SELECT reading_id, {R('process_temp_k - air_temp_k', 6)} AS delta_t, {R(POWER, 6)} AS power_w,
  {R('tool_wear_min * torque_nm', 6)} AS strain FROM readings
""")(
    lambda r: r.select(
        "reading_id",
        report_round(rules.delta_t(), 6).alias("delta_t"),
        report_round(rules.power_w(), 6).alias("power_w"),
        report_round(rules.strain(), 6).alias("strain"),
    )
)

SIGNATURE = f"""
, s AS (SELECT reading_id, tool_wear_min > 200 AS twf, tool_wear_min > 200 AND torque_nm > 60 AS twf_strong,
    round(process_temp_k - air_temp_k, 6) < 8.6e0 AND rpm < 1380 AS hdf,
    NOT ({POWER} BETWEEN 3500 AND 9000) AS pwf,
    tool_wear_min * torque_nm > CASE product_type WHEN 'L' THEN 11000 WHEN 'M' THEN 12000 ELSE 13000 END AS osf
  FROM readings)
SELECT *, NOT (twf OR hdf OR pwf OR osf) AS rnf FROM s
"""
OSF_LIMITS = {"L": 11000.0, "M": 12000.0, "H": 13000.0}
register("mode_signature", ["readings"], SIGNATURE)(
    lambda r: r.select("reading_id", *[c.alias(m) for m, c in rules.mode_signature(OSF_LIMITS).items()])
)


def _deviation_sql(column, low, high):
    return f"""{R(f'''CASE WHEN {column} < {low} THEN ({column} - {low}) * 100e0 / nullif(abs({low}), 0)
      WHEN {column} > {high} THEN ({column} - {high}) * 100e0 / nullif(abs({high}), 0) ELSE 0 END''', 4)} AS {column}"""


register("range_deviation", ["stressed"], f"""
SELECT reading_id, {', '.join(_deviation_sql(c, f'{lo}e0', f'{hi}e0') for c, (lo, hi) in rules.SENSOR_RANGES.items())}
FROM stressed
""")(
    lambda r: r.select(
        "reading_id",
        *[
            report_round(rules.range_deviation(F.col(c), F.lit(lo), F.lit(hi)), 4).alias(c)
            for c, (lo, hi) in rules.SENSOR_RANGES.items()
        ],
    )
)

register("deviation_pct", ["process_readings"], f"""
SELECT reading_id, tag, CASE WHEN nominal_value = 0 THEN 0e0
  ELSE {R('(value - nominal_value) / abs(nominal_value) * 100e0', 2)} END AS deviation FROM process_readings
""")(
    lambda p: p.select(
        "reading_id", "tag", rules.deviation_pct(F.col("value"), F.col("nominal_value")).alias("deviation")
    )
)

register("hotspot_intensity", ["readings"], """
SELECT reading_id, CASE WHEN rpm / 4e0 - 250 <= 60 THEN 'none' WHEN rpm / 4e0 - 250 <= 200 THEN 'low'
  WHEN rpm / 4e0 - 250 <= 400 THEN 'medium' ELSE 'high' END AS intensity FROM readings
""")(
    lambda r: r.select(
        "reading_id", rules.hotspot_intensity(F.col("rpm") / F.lit(4.0) - 250).alias("intensity")
    )
)

register("fire_size", ["readings"], """
SELECT reading_id, CASE WHEN tool_wear_min = 0 THEN 'none' WHEN tool_wear_min / 40e0 <= 1 THEN 'small'
  WHEN tool_wear_min / 40e0 <= 5 THEN 'medium' ELSE 'large' END AS size FROM readings
""")(lambda r: r.select("reading_id", rules.fire_size(F.col("tool_wear_min") / F.lit(40.0)).alias("size")))


def _scene_ids(scenes):
    scene = rules.scene_id(F.col("category"), F.lpad(F.col("scene_no").cast("string"), 5, "0"))
    named = scenes.select("scene_no", scene.alias("scene_id"))
    rgb, thermal = (rules.image_name(F.col("scene_id"), kind) for kind in ("rgb", "thermal"))
    return named.select(
        "scene_no", "scene_id", rgb.alias("rgb"), thermal.alias("thermal"), rules.scene_of_image(rgb).alias("back")
    )


register("scene_id", ["scenes"], """
, s AS (SELECT scene_no, replace(lower(category), ' ', '_') || '_' || lpad(CAST(scene_no AS STRING), 5, '0')
    AS scene_id FROM scenes)
SELECT scene_no, scene_id, scene_id || '_rgb.jpg' AS rgb, scene_id || '_thermal.jpg' AS thermal, scene_id AS back FROM s
""")(_scene_ids)

register("extract_json", ["model_outputs"], """
, f AS (SELECT sample_id, raw, CASE WHEN starts_with(raw, repeat(chr(96), 3)) THEN regexp_replace(regexp_replace(raw,
    '^[^\\n]*\\n', ''), '^(.*)' || repeat(chr(96), 3) || '.*$', '\\1', 's') ELSE raw END AS body FROM model_outputs),
s AS (SELECT sample_id, nullif(regexp_extract(body, '\\{.*\\}', 0, 's'), '') AS span FROM f)
SELECT sample_id, span, coalesce(json_valid(span), false) AS parsed FROM s
""")(
    lambda m: m.select(
        "sample_id",
        jsontext.json_span(F.col("raw")).alias("span"),
        jsontext.extract_json(F.col("raw")).isNotNull().alias("parsed"),
    )
)

register("folio", ["alerts"], """
SELECT alert_id, 'OT-' || strftime(event_ts, '%Y%m%d') || '-' || CASE WHEN alert_id < 100 THEN
  lpad(CAST(alert_id AS STRING), 3, '0') ELSE CAST(alert_id AS STRING) END AS folio FROM alerts
""")(lambda a: a.select("alert_id", rules.folio(F.col("event_ts"), F.col("alert_id")).alias("folio")))

register("encode_product_type", ["readings"], """
SELECT reading_id, CASE product_type WHEN 'L' THEN 0 WHEN 'M' THEN 1 WHEN 'H' THEN 2 END AS code FROM readings
""")(lambda r: r.select("reading_id", rules.encode_product_type(F.col("product_type")).alias("code")))

register("feature_vector", ["readings"], """
SELECT reading_id, air_temp_k AS f0, process_temp_k AS f1, CAST(rpm AS DOUBLE) AS f2, torque_nm AS f3,
  CAST(tool_wear_min AS DOUBLE) AS f4, CAST(CASE product_type WHEN 'L' THEN 0 WHEN 'M' THEN 1 WHEN 'H' THEN 2 END
  AS DOUBLE) AS f5 FROM readings
""")(
    lambda r: filters.feature_vector(r).select(
        "reading_id", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(6)]
    )
)

register("mode_label", ["alerts"], f"""
SELECT alert_id, failure_mode, {MODE_CASE} AS label FROM alerts
""")(lambda a: knowledge.mode_label(a.select("alert_id", "failure_mode"), "failure_mode", "label"))

register("signal_tag", ["readings"], """
SELECT reading_id, CASE WHEN anomaly_score > 0.85 THEN 'good' WHEN anomaly_score > 0.5 THEN 'weak' ELSE 'none' END
  AS signal FROM readings
""")(lambda r: r.select("reading_id", rules.signal_tag(F.col("anomaly_score")).alias("signal")))

register("alert_stream", ["readings"], f"""
SELECT equipment_id, node_id, node_name, reading_id, event_ts,
  CASE WHEN anomaly_score <= 0 THEN 'MULTIPLE' ELSE {first_mode(BY_MODE)} END AS failure_mode,
  anomaly_score AS probability, CASE WHEN anomaly_score >= 0.9 THEN 'critical' WHEN anomaly_score >= 0.8 THEN 'high'
  ELSE 'medium' END AS severity, anomaly_score, air_temp_k, process_temp_k, rpm, torque_nm, tool_wear_min,
  CAST(0 AS INT) AS resolved, CAST(NULL AS TIMESTAMP) AS resolved_at FROM readings WHERE anomaly_score >= 0.65
""")(lambda r: alert_stream(r).drop("alert_id"))
