"""Exact ranking and classification metrics without a global sort in one task.

Scores are grouped by value first; running counts over the distinct scores then come from
`ordered.running`, which spreads one label over many tasks. Everything is keyed by the `by` columns,
so all labels of a multi-label problem are measured in one job. Rows without a score or label are
ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantwatch.functions.numbers import safe_ratio
from plantwatch.functions.rules import FAILURE_PROBABILITY, anomaly_score, signal_tag
from plantwatch.operators.ordered import ROWS_PER_SLICE, running, slice_rows

F1_EPSILON = 1e-8


def long_form(df: DataFrame, pairs: Mapping[str, tuple[str, str]], name: str = "mode") -> DataFrame:
    """One row per (row, label) as (name, score, label), from {name: (score column, label column)}."""
    entries = [
        F.struct(F.lit(n).alias(name), F.col(s).cast("double").alias("score"), F.col(y).cast("int").alias("label"))
        for n, (s, y) in pairs.items()
    ]
    return df.select(F.inline(F.array(*entries)))


def score_cumulative(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    by: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One row per distinct score with the positives and negatives at it (`d_tp`, `d_fp`), at or
    above it (`tp`, `fp`), and in all (`tp_all`, `fp_all`)."""
    positive = (F.col(label) == 1).cast("long")
    per_score = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.sum(positive).alias("d_tp"), F.sum(1 - positive).alias("d_fp"))
        .withColumn("_falling", -F.col("score"))
    )
    counts = {"tp": ("sum", F.col("d_tp")), "fp": ("sum", F.col("d_fp"))}
    sliced = slice_rows(per_score, by, ["_falling"], rows_per_slice, checkpoint=True)
    return running(sliced, counts, whole=["tp", "fp"]).rows().drop("_falling")


def _with_origin(curve: DataFrame, by: Sequence[str], origin: Mapping[str, Column]) -> DataFrame:
    first = curve.select(*by).distinct() if by else curve.sparkSession.range(1).select()
    return curve.unionByName(first.select(*by, *[value.alias(name) for name, value in origin.items()]))


def roc_curve(cumulative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(fpr, tpr, threshold) from `score_cumulative`, with the start (0, 0) at threshold infinity."""
    points = cumulative.select(
        *by,
        F.try_divide("fp", "fp_all").alias("fpr"),
        F.try_divide("tp", "tp_all").alias("tpr"),
        F.col("score").alias("threshold"),
    )
    origin = {"fpr": F.lit(0.0), "tpr": F.lit(0.0), "threshold": F.lit(float("inf"))}
    return _with_origin(points, by, origin)


def pr_curve(cumulative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(recall, precision, threshold) from `score_cumulative`; the end point (0, 1) has no threshold."""
    points = cumulative.select(
        *by,
        F.try_divide("tp", "tp_all").alias("recall"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.col("score").alias("threshold"),
    )
    end = {"recall": F.lit(0.0), "precision": F.lit(1.0), "threshold": F.lit(None).cast("double")}
    return _with_origin(points, by, end)


def _auc() -> Column:
    # Twice the area in units of one (positive, negative) pair: exact for any table size.
    twice = F.sum(F.col("d_fp").cast("decimal(19,0)") * (2 * F.col("tp") - F.col("d_tp")).cast("decimal(19,0)"))
    pairs = F.sum("d_tp").cast("double") * F.sum("d_fp").cast("double") * 2.0
    return F.try_divide(twice.cast("double"), pairs)


def _average_precision() -> Column:
    return F.try_divide(
        F.sum(F.col("d_tp") * (F.col("tp") / (F.col("tp") + F.col("fp")))), F.sum("d_tp").cast("double")
    )


def _pr_area() -> Column:
    seen_before = F.col("tp") + F.col("fp") - F.col("d_tp") - F.col("d_fp")
    before = F.when(seen_before == 0, F.lit(1.0)).otherwise(
        F.try_divide(F.col("tp") - F.col("d_tp"), seen_before)
    )
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    return F.try_divide(F.sum(F.col("d_tp") * (here + before) / 2.0), F.sum("d_tp").cast("double"))


def _f1() -> Column:
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.try_divide("tp", "tp_all")
    return 2 * precision * recall / (precision + recall + F.lit(F1_EPSILON))


def _best_f1() -> Column:
    """struct(f1, -threshold): the largest F1, and the lowest threshold among equals."""
    return F.max(F.struct(_f1().alias("f1"), (-F.col("score")).alias("falling")))


def roc_auc(cumulative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL where a class is missing."""
    return cumulative.groupBy(*by).agg(_auc().alias("auc"))


def macro_mean(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias(f"{value}_macro"))


def average_precision(cumulative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Step sum of precision over recall."""
    return cumulative.groupBy(*by).agg(_average_precision().alias("average_precision"))


def pr_auc(cumulative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under the precision-recall curve."""
    return cumulative.groupBy(*by).agg(_pr_area().alias("pr_auc"))


def best_f1_threshold(cumulative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (
        cumulative.groupBy(*by)
        .agg(_best_f1().alias("_best"))
        .select(*by, (-F.col("_best.falling")).alias("threshold"), F.col("_best.f1").alias("f1"))
    )


def confusion(
    df: DataFrame, truth: str = "machine_failure", predicted: str = "predicted_failure", by: Sequence[str] = ()
) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    cells = {"tn": ~t & ~p, "fp": ~t & p, "fn": t & ~p, "tp": t & p}
    return df.groupBy(*by).agg(*[F.count_if(hit).alias(name) for name, hit in cells.items()])


def _f1_of(precision: Column, recall: Column) -> Column:
    return safe_ratio(2 * precision * recall, precision + recall)


def classification_report(
    df: DataFrame,
    truth: str = "machine_failure",
    predicted: str = "predicted_failure",
    names: Sequence[str] = ("normal", "failure"),
) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    Rows are named in `class`; a metric with a zero denominator is 0.
    """
    c = confusion(df, truth, predicted)
    tn, fp, fn, tp = (F.col(name).cast("double") for name in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp

    def row(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.cast("long").alias("support"),
        )

    p0, r0, s0 = safe_ratio(tn, tn + fn), safe_ratio(tn, tn + fp), tn + fp
    p1, r1, s1 = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn), fn + tp
    f0, f1 = _f1_of(p0, r0), _f1_of(p1, r1)
    accuracy = safe_ratio(tn + tp, total)

    def macro(a, b):
        return (a + b) / 2.0

    def weighted(a, b):
        return safe_ratio(a * s0 + b * s1, total)

    rows = [
        row(names[0], p0, r0, f0, s0),
        row(names[1], p1, r1, f1, s1),
        row("accuracy", accuracy, accuracy, accuracy, total),
        row("macro avg", macro(p0, p1), macro(r0, r1), macro(f0, f1), total),
        row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), total),
    ]
    return c.select(F.inline(F.array(*rows)))


def f1_per_label(scored: DataFrame, by: str = "mode", threshold: float = FAILURE_PROBABILITY) -> DataFrame:
    """F1 per label of `long_form` rows at a fixed threshold; 0 where undefined."""
    hits = scored.withColumn("_predicted", (F.col("score") >= threshold).cast("int"))
    tp, fp, fn = (F.col(n) for n in ("tp", "fp", "fn"))
    counts = confusion(hits, "label", "_predicted", [by])
    return counts.select(by, safe_ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


def f1_macro(scored: DataFrame, by: str = "mode", threshold: float = FAILURE_PROBABILITY) -> DataFrame:
    return macro_mean(f1_per_label(scored, by, threshold), "f1")


def per_label_report(
    scored: DataFrame, by: str = "mode", min_positives: int = 2, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """AUC, best threshold, best F1, positives and signal tag per label, in one job.

    A label with too few positives has no AUC, threshold 0.5 and F1 0.
    """
    measured = (
        score_cumulative(scored, by=[by], rows_per_slice=rows_per_slice)
        .groupBy(by)
        .agg(_auc().alias("auc"), _best_f1().alias("_best"), F.sum("d_tp").alias("n_pos"))
    )
    enough = F.col("n_pos") >= min_positives
    auc = F.when(enough, F.col("auc"))
    return measured.select(
        by,
        auc.alias("auc"),
        F.when(enough, -F.col("_best.falling")).otherwise(F.lit(0.5)).alias("best_threshold"),
        F.when(enough, F.col("_best.f1")).otherwise(F.lit(0.0)).alias("best_f1"),
        "n_pos",
        signal_tag(auc).alias("signal"),
    )


def any_failure_report(
    df: DataFrame,
    probabilities: Sequence[str],
    truth: str = "machine_failure",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One row: AUC, best threshold and F1 of the highest probability, and the confusion counts,
    precision and recall at that threshold."""
    scored = df.select(
        anomaly_score([F.col(p) for p in probabilities]).alias("score"), F.col(truth).alias("label")
    )
    # The running counts at the best threshold are its true and false positives.
    best = F.max(
        F.struct(
            _f1().alias("f1"), (-F.col("score")).alias("falling"), "tp", "fp", "tp_all", "fp_all"
        )
    )
    measured = score_cumulative(scored, rows_per_slice=rows_per_slice).agg(
        _auc().alias("auc"), best.alias("b")
    )
    return measured.select(
        "auc",
        (-F.col("b.falling")).alias("threshold"),
        F.col("b.f1").alias("f1"),
        (F.col("b.fp_all") - F.col("b.fp")).alias("tn"),
        F.col("b.fp").alias("fp"),
        (F.col("b.tp_all") - F.col("b.tp")).alias("fn"),
        F.col("b.tp").alias("tp"),
        safe_ratio(F.col("b.tp"), F.col("b.tp") + F.col("b.fp")).alias("precision"),
        safe_ratio(F.col("b.tp"), F.col("b.tp_all")).alias("recall"),
    )


def prevalence(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of positives, the baseline of a precision-recall curve."""
    return df.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("prevalence"))


def attach_predictions(df: DataFrame, predictions: DataFrame, key: str = "UDI") -> DataFrame:
    """Rows with their predictions, matched by key and not by position."""
    overlap = [c for c in predictions.columns if c != key and c in df.columns]
    return df.join(predictions.drop(*overlap), key)
