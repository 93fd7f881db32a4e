"""Ranking and classification metrics over the readings and their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch.functions.numbers import report_round
from plantwatch.functions.rules import MODES, PROBABILITIES
from plantwatch.operators import metrics
from plantwatch.registry.book import register, rounded

R = rounded
# Few distinct scores per slice, so that the running counts cross slices in the test tables.
PAIRS = {m: (p, m.lower()) for m, p in zip(MODES, PROBABILITIES)}


def six(df, *columns):
    for c in columns:
        df = df.withColumn(c, report_round(F.col(c), 6))
    return df


LONG = " UNION ALL ".join(f"SELECT '{m}' AS mode, {p} AS score, {y} AS label FROM cases" for m, (p, y) in PAIRS.items())
# Running counts per distinct score; `k` is the label group.
CUMULATIVE = """d AS (SELECT k, score, CAST(sum(label) AS BIGINT) AS d_tp, CAST(sum(1 - label) AS BIGINT) AS d_fp
    FROM l GROUP BY k, score),
c AS (SELECT *, CAST(sum(d_tp) OVER w AS BIGINT) AS tp, CAST(sum(d_fp) OVER w AS BIGINT) AS fp,
    CAST(sum(d_tp) OVER (PARTITION BY k) AS BIGINT) AS tp_all, CAST(sum(d_fp) OVER (PARTITION BY k) AS BIGINT) AS fp_all
  FROM d WINDOW w AS (PARTITION BY k ORDER BY score DESC))"""
ONE = f", l AS (SELECT 0 AS k, anomaly_score AS score, machine_failure AS label FROM readings), {CUMULATIVE}"
MANY = f", l AS (SELECT mode AS k, score, label FROM ({LONG})), {CUMULATIVE}"
# The Mann-Whitney form of the area, with mid-ranks for ties: an independent definition.
MANN_WHITNEY = """, r AS (SELECT k, label, rank() OVER (PARTITION BY k ORDER BY score) AS low,
    count(*) OVER (PARTITION BY k, score) AS ties FROM l),
u AS (SELECT k, sum(CASE WHEN label = 1 THEN low + (ties - 1) / 2e0 END) AS ranks, sum(label) AS p,
    count(*) - sum(label) AS n FROM r GROUP BY k),
a AS (SELECT k, CASE WHEN p > 0 AND n > 0 THEN (ranks - p * (p + 1) / 2e0) / (CAST(p AS DOUBLE) * n) END AS auc, p FROM u)"""


def overall(readings):
    return metrics.score_cumulative(readings, "anomaly_score", "machine_failure")


def per_mode(cases):
    return metrics.score_cumulative(metrics.long_form(cases, PAIRS), by=["mode"])


register("score_cumulative", ["cases"], MANY + """
SELECT k AS mode, score, d_tp, d_fp, tp, fp, tp_all, fp_all FROM c
""")(per_mode)

register("roc_curve", ["readings"], ONE + f"""
SELECT {R('fp * 1e0 / fp_all', 6)} AS fpr, {R('tp * 1e0 / tp_all', 6)} AS tpr, score AS threshold FROM c
UNION ALL SELECT 0e0, 0e0, CAST('Infinity' AS DOUBLE)
""")(lambda r: six(metrics.roc_curve(overall(r)), "fpr", "tpr"))

register("pr_curve", ["cases"], MANY + f"""
SELECT k AS mode, {R('tp * 1e0 / tp_all', 6)} AS recall, {R('tp * 1e0 / (tp + fp)', 6)} AS precision, score AS threshold FROM c
UNION ALL SELECT DISTINCT k, 0e0, 1e0, CAST(NULL AS DOUBLE) FROM c
""")(lambda c: six(metrics.pr_curve(per_mode(c), ["mode"]), "recall", "precision"))

register("roc_auc", ["readings"], ONE + MANN_WHITNEY + f"SELECT {R('auc', 6)} AS auc FROM a")(
    lambda r: six(metrics.roc_auc(overall(r)), "auc")
)

register("roc_auc_per_mode", ["cases"], MANY + MANN_WHITNEY + f"SELECT k AS mode, {R('auc', 6)} AS auc FROM a")(
    lambda c: six(metrics.roc_auc(per_mode(c), ["mode"]), "auc")
)

register("roc_auc_macro", ["cases"], MANY + MANN_WHITNEY + f"SELECT {R('avg(auc)', 6)} AS auc_macro FROM a")(
    lambda c: six(metrics.macro_mean(metrics.roc_auc(per_mode(c), ["mode"]), "auc"), "auc_macro")
)

register("average_precision", ["readings"], ONE + f"""
SELECT {R('sum(d_tp * (tp * 1e0 / (tp + fp))) / sum(d_tp)', 6)} AS average_precision FROM c
""")(lambda r: six(metrics.average_precision(overall(r)), "average_precision"))

register("pr_auc", ["cases"], MANY + f"""
, t AS (SELECT k, d_tp, tp * 1e0 / (tp + fp) AS p, coalesce(lag(tp * 1e0 / (tp + fp)) OVER (PARTITION BY k ORDER BY score DESC), 1) AS q FROM c)
SELECT k AS mode, {R('sum(d_tp * (p + q) / 2) / sum(d_tp)', 6)} AS pr_auc FROM t GROUP BY k
""")(lambda c: six(metrics.pr_auc(per_mode(c), ["mode"]), "pr_auc"))

F1 = """, f AS (SELECT *, 2 * (tp * 1e0 / (tp + fp)) * (tp * 1e0 / tp_all)
    / ((tp * 1e0 / (tp + fp)) + (tp * 1e0 / tp_all) + 1e-8) AS f1 FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f1 DESC, score) AS rn FROM f)"""
register("best_f1_threshold", ["cases"], MANY + F1 + f"""
SELECT k AS mode, score AS threshold, {R('f1', 6)} AS f1 FROM b WHERE rn = 1
""")(lambda c: six(metrics.best_f1_threshold(per_mode(c), ["mode"]), "f1"))

CELLS = """CAST(count(*) FILTER (machine_failure = 0 AND predicted_failure = 0) AS BIGINT) AS tn,
  CAST(count(*) FILTER (machine_failure = 0 AND predicted_failure = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (machine_failure = 1 AND predicted_failure = 0) AS BIGINT) AS fn,
  CAST(count(*) FILTER (machine_failure = 1 AND predicted_failure = 1) AS BIGINT) AS tp"""
register("confusion", ["readings"], f"SELECT {CELLS} FROM readings")(metrics.confusion)

register("classification_report", ["readings"], f"""
, c AS (SELECT {CELLS} FROM readings),
m AS (SELECT 'normal' AS class, tn * 1e0 / (tn + fn) AS p, tn * 1e0 / (tn + fp) AS r, tn + fp AS s, 0 AS o FROM c
  UNION ALL SELECT 'failure', tp * 1e0 / (tp + fp), tp * 1e0 / (tp + fn), fn + tp, 1 FROM c),
f AS (SELECT class, p, r, 2 * p * r / (p + r) AS f1, s FROM m),
a AS (SELECT class, p, r, f1, s FROM f UNION ALL
  SELECT 'accuracy', (tn + tp) * 1e0 / (tn + fp + fn + tp), (tn + tp) * 1e0 / (tn + fp + fn + tp),
    (tn + tp) * 1e0 / (tn + fp + fn + tp), tn + fp + fn + tp FROM c UNION ALL
  SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(s) FROM f UNION ALL
  SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f1 * s) / sum(s), sum(s) FROM f)
SELECT class, {R('p', 6)} AS precision, {R('r', 6)} AS recall, {R('f1', 6)} AS f1, CAST(s AS BIGINT) AS support FROM a
""")(lambda r: six(metrics.classification_report(r), "precision", "recall", "f1"))

FIXED = f""", l AS ({LONG}),
f AS (SELECT mode, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (label = 1 AND score < 0.5) AS fn FROM l GROUP BY mode),
g AS (SELECT mode, coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM f)"""
register("f1_per_label", ["cases"], FIXED + f"SELECT mode, {R('f1', 6)} AS f1 FROM g")(
    lambda c: six(metrics.f1_per_label(metrics.long_form(c, PAIRS)), "f1")
)

register("f1_macro", ["cases"], FIXED + f"SELECT {R('avg(f1)', 6)} AS f1_macro FROM g")(
    lambda c: six(metrics.f1_macro(metrics.long_form(c, PAIRS)), "f1_macro")
)

register("per_label_report", ["cases"], MANY + F1 + MANN_WHITNEY + f"""
SELECT b.k AS mode, {R('CASE WHEN p >= 2 THEN auc END', 6)} AS auc, CASE WHEN p >= 2 THEN score ELSE 0.5e0 END AS best_threshold,
  {R('CASE WHEN p >= 2 THEN f1 ELSE 0e0 END', 6)} AS best_f1, CAST(p AS BIGINT) AS n_pos,
  CASE WHEN p >= 2 AND auc > 0.85 THEN 'good' WHEN p >= 2 AND auc > 0.5 THEN 'weak' ELSE 'none' END AS signal
FROM b JOIN a ON a.k = b.k WHERE rn = 1
""")(
    lambda c: six(
        metrics.per_label_report(metrics.long_form(c, PAIRS)), "auc", "best_f1"
    )
)

register("any_failure_report", ["readings"], ONE + F1 + MANN_WHITNEY + f"""
SELECT {R('auc', 6)} AS auc, score AS threshold, {R('f1', 6)} AS f1, fp_all - fp AS tn, fp, tp_all - tp AS fn, tp,
  {R('tp * 1e0 / (tp + fp)', 6)} AS precision, {R('tp * 1e0 / tp_all', 6)} AS recall
FROM b JOIN a ON a.k = b.k WHERE rn = 1
""")(
    lambda r: six(
        metrics.any_failure_report(r, PROBABILITIES), "auc", "f1", "precision", "recall"
    )
)

register("prevalence", ["cases"], f"""
, l AS ({LONG}) SELECT mode, {R('avg(label)', 6)} AS prevalence FROM l GROUP BY mode
""")(lambda c: six(metrics.prevalence(metrics.long_form(c, PAIRS), "label", ["mode"]), "prevalence"))

register("attach_predictions", ["readings"], """
SELECT reading_id, product_type, machine_failure, anomaly_score, predicted_failure FROM readings
""")(
    lambda r: metrics.attach_predictions(
        r.select("reading_id", "product_type", "machine_failure"),
        r.select("reading_id", "anomaly_score", "predicted_failure"),
        "reading_id",
    )
)
