"""Scored model answers and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch.functions.numbers import report_round
from plantwatch.operators import modelruns
from plantwatch.registry.book import register, rounded

R = rounded
FIELDS = ("t", "k")


def scored(outputs):
    truth = F.format_string('{"t": "%s", "k": %d}', "truth_type", "truth_k")
    return modelruns.score_fields(outputs.withColumn("truth", truth), FIELDS)


def six(df, *columns):
    for c in columns:
        df = df.withColumn(c, report_round(F.col(c), 6))
    return df


SCORED = """
, f AS (SELECT *, CASE WHEN starts_with(raw, repeat(chr(96), 3)) THEN regexp_replace(regexp_replace(raw,
    '^[^\\n]*\\n', ''), '^(.*)' || repeat(chr(96), 3) || '.*$', '\\1', 's') ELSE raw END AS body FROM model_outputs),
g AS (SELECT *, nullif(regexp_extract(body, '\\{.*\\}', 0, 's'), '') AS span FROM f),
h AS (SELECT *, CASE WHEN json_valid(span) THEN span END AS js FROM g),
s AS (SELECT sample_id, run, truth_type, truth_k, latency_s, js, CAST(js IS NOT NULL AS INT) AS valid_json,
    CAST(coalesce(json_exists(js, '$.t') AND json_exists(js, '$.k'), false) AS INT) AS fields_present,
    CAST(coalesce(json_extract_string(js, '$.t') = truth_type, false) AS INT) AS t,
    CAST(coalesce(CAST(json_extract_string(js, '$.k') AS INT) = truth_k, false) AS INT) AS k FROM h)
"""

register("score_fields", ["model_outputs"], SCORED + """
SELECT sample_id, run, valid_json, fields_present, t, k FROM s
""")(lambda m: scored(m).select("sample_id", "run", "valid_json", "fields_present", "t", "k"))

SUMMARY = """, m AS (SELECT run, count(*) AS n, avg(latency_s) AS avg_latency_s, sum(t + k) / (count(*) * 2e0) AS overall,
  avg(valid_json) AS valid_json, avg(fields_present) AS fields_present, avg(t) AS t, avg(k) AS k FROM s GROUP BY run)"""
MEASURES = ("avg_latency_s", "overall", "valid_json", "fields_present", "t", "k")
register("run_summary", ["model_outputs"], SCORED + SUMMARY + f"""
SELECT run, CAST(n AS BIGINT) AS n, {', '.join(f'{R(x, 6)} AS {x}' for x in MEASURES)} FROM m
""")(lambda m: six(modelruns.run_summary(scored(m), FIELDS), *MEASURES))

register("compare_runs", ["model_outputs"], SCORED + SUMMARY + f"""
, l AS ({' UNION ALL '.join(f"SELECT '{x}' AS measure, run, CAST({x} AS DOUBLE) AS v FROM m" for x in ('n', *MEASURES))}),
w AS (SELECT measure, coalesce(max(v) FILTER (run = 'base'), 0) AS base, coalesce(max(v) FILTER (run = 'tuned'), 0) AS tuned,
  coalesce(max(v) FILTER (run = 'third'), 0) AS third FROM l GROUP BY measure)
SELECT measure, {R('base', 6)} AS base, {R('third', 6)} AS third, {R('tuned', 6)} AS tuned, {R('tuned - base', 6)} AS delta FROM w
""")(
    lambda m: six(
        modelruns.compare_runs(modelruns.run_summary(scored(m), FIELDS), ["base", "third", "tuned"]),
        "base",
        "third",
        "tuned",
        "delta",
    )
)

register("latency_stats", ["model_outputs"], f"""
SELECT run, {R('avg(latency_s)', 6)} AS avg_s, min(latency_s) AS min_s, max(latency_s) AS max_s FROM model_outputs GROUP BY run
""")(lambda m: six(modelruns.latency_stats(m), "avg_s"))

register("errors_by_field", ["model_outputs"], SCORED + " UNION ALL ".join(
    f"""SELECT run, '{f}' AS field, CAST(sum(1 - {f}) AS BIGINT) AS errors, {R(f'1 - sum(1e0 - {f}) / count(*)', 6)} AS accuracy
    FROM s GROUP BY run""" for f in FIELDS
))(lambda m: six(modelruns.errors_by_field(scored(m), FIELDS, ["run"]), "accuracy"))

register("field_confusion", ["model_outputs"], SCORED + """
SELECT run, truth_type AS true_value, coalesce(json_extract_string(js, '$.t'), 'None') AS predicted_value,
  CAST(count(*) AS BIGINT) AS n FROM s WHERE t = 0 GROUP BY ALL
""")(lambda m: modelruns.field_confusion(scored(m), "t", by=["run"]))
