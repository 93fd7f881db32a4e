"""Metrics against small worked cases and known summaries."""

import math

import pytest
from pyspark.sql import functions as F

from plantwatch.operators import metrics as m

CONFUSION = {"tn": 9332, "fp": 329, "fn": 274, "tp": 65}


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "score double, label int")


def curve(spark, pairs, rows=2):
    return m.score_cumulative(scored(spark, pairs), rows_per_slice=rows)


def auc(spark, pairs):
    return m.roc_auc(curve(spark, pairs)).first().auc


def test_auc_cases(spark):
    assert auc(spark, [(0.5, 1), (0.5, 0), (0.5, 0)]) == 0.5
    assert auc(spark, [(0.9, 1), (0.8, 1), (0.1, 0)]) == 1.0
    assert auc(spark, [(0.9, 1), (0.8, 1)]) is None
    assert auc(spark, [(0.1, 1), (0.4, 1), (0.35, 0), (0.8, 0), (None, 1)]) == 0.25


def test_auc_properties(spark):
    rows = spark.range(500).selectExpr("CAST(id * 37 % 101 AS DOUBLE) AS score", "CAST(id * 53 % 97 > 70 AS INT) AS label")
    first = m.roc_auc(m.score_cumulative(rows, rows_per_slice=13)).first().auc
    turned = m.roc_auc(m.score_cumulative(rows.withColumn("score", -F.col("score")), rows_per_slice=13)).first().auc
    bent = m.roc_auc(m.score_cumulative(rows.withColumn("score", F.exp(F.col("score") / 50)))).first().auc
    assert math.isclose(first, 1 - turned, abs_tol=1e-12)
    assert math.isclose(first, bent, abs_tol=1e-12)


def test_large_counts_do_not_overflow(spark):
    big = 10**11
    rows = spark.createDataFrame([(0.9, big, 0, big, 0), (0.1, 0, big, big, big)], "score double, d_tp long, d_fp long, tp long, fp long")
    assert m.roc_auc(rows).first().auc == 1.0


def test_precision_recall_numbers(spark):
    pairs = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)]
    c = curve(spark, pairs)
    assert math.isclose(m.average_precision(c).first().average_precision, 0.8333333333333333)
    assert math.isclose(m.pr_auc(c).first().pr_auc, 0.7916666666666666)
    points = {(r.recall, round(r.precision, 6)) for r in m.pr_curve(c).collect()}
    assert points == {(1.0, 0.5), (1.0, 0.666667), (0.5, 0.5), (0.5, 1.0), (0.0, 1.0)}
    roc = {(r.fpr, r.tpr) for r in m.roc_curve(c).collect()}
    assert roc == {(0.0, 0.0), (0.0, 0.5), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)}


def test_f1_ties_take_the_lowest_threshold(spark):
    # F1 is 2/3 at 0.9 (1 of 2 found, no error) and at 0.3 (2 found, 2 errors).
    pairs = [(0.9, 1), (0.6, 0), (0.5, 0), (0.3, 1)]
    best = m.best_f1_threshold(curve(spark, pairs)).first()
    assert best.threshold == 0.3 and math.isclose(best.f1, 2 / 3, abs_tol=1e-6)


def test_known_report(spark):
    rows = [(t, p, CONFUSION[c]) for c, (t, p) in {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}.items()]
    df = spark.createDataFrame(rows, "machine_failure int, predicted_failure int, n int").select(
        "machine_failure", "predicted_failure", F.explode(F.sequence(F.lit(1), "n"))
    )
    assert m.confusion(df).first().asDict() == CONFUSION
    report = {r["class"]: r for r in m.classification_report(df).collect()}
    failure = report["failure"]
    assert round(failure.precision, 5) == 0.16497
    assert round(failure.recall, 5) == 0.19174
    assert round(failure.f1, 4) == 0.1774
    assert failure.support == 339
    assert round(report["accuracy"].f1, 4) == 0.9397


def test_report_with_empty_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "machine_failure int, predicted_failure int")
    report = {r["class"]: r for r in m.classification_report(df).collect()}
    assert report["failure"].precision == report["failure"].recall == report["failure"].f1 == 0.0


def test_label_with_one_positive(spark):
    df = spark.createDataFrame(
        [("A", 0.9, 1), ("A", 0.1, 0), ("B", 0.9, 1), ("B", 0.8, 1), ("B", 0.1, 0)], "mode string, score double, label int"
    )
    got = {r["mode"]: r for r in m.per_label_report(df, rows_per_slice=2).collect()}
    assert (got["A"].auc, got["A"].best_threshold, got["A"].best_f1, got["A"].signal) == (None, 0.5, 0.0, "none")
    assert (got["B"].auc, got["B"].best_threshold, got["B"].signal) == (1.0, 0.8, "good")


def test_known_macro(spark):
    aucs = spark.createDataFrame([(x,) for x in (0.9529, 0.9522, 0.4848, 0.9244, 0.2875)], "auc double")
    assert round(m.macro_mean(aucs, "auc").first().auc_macro, 4) == 0.7204


def test_any_failure_confusion_is_that_of_the_threshold(spark):
    rows = spark.range(300).selectExpr(
        "CAST(id * 37 % 101 AS DOUBLE) / 100 AS a", "CAST(id * 11 % 89 AS DOUBLE) / 100 AS b", "CAST(id * 53 % 97 > 80 AS INT) AS y"
    )
    got = m.any_failure_report(rows, ["a", "b"], "y", rows_per_slice=7).first()
    hits = rows.withColumn("p", (F.greatest("a", "b") >= got.threshold).cast("int"))
    assert m.confusion(hits, "y", "p").first().asDict() == {k: got[k] for k in ("tn", "fp", "fn", "tp")}


@pytest.mark.parametrize("threshold, expected", [(0.5, 2 / 3), (0.95, 0.0)])
def test_f1_at_fixed_threshold(spark, threshold, expected):
    df = spark.createDataFrame([("A", 0.9, 1), ("A", 0.5, 0), ("A", 0.1, 0)], "mode string, score double, label int")
    assert math.isclose(m.f1_per_label(df, threshold=threshold).first().f1, expected)
