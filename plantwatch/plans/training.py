"""From tables to fitted and measured models, and from scenes to training rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.functions.rules import encode_product_type
from plantwatch.operators import metrics
from plantwatch.operators.filters import feature_names, normal_only
from plantwatch.operators.forest import IsolationForest, IsolationForestModel
from plantwatch.operators.multilabel import MultiLabelModel, fit_multilabel
from plantwatch.operators.ordered import ROWS_PER_SLICE, lag_windows
from plantwatch.operators.prep import ZScore, apply_zscore, fit_zscore, stratified_split
from plantwatch.operators.scenes import build_chat_rows, build_labels, label_rows
from plantwatch.operators.summaries import detection_by_mode
from plantwatch.session import cut_lineage


def with_type_code(readings: DataFrame) -> DataFrame:
    return readings.withColumn("type_code", encode_product_type(F.col("product_type")).cast("double"))


def fit_forest(readings: DataFrame, by: Sequence[str], forest: IsolationForest | None = None) -> IsolationForestModel:
    """Forest on the readings without a failure, over the five sensors and the product grade."""
    return (forest or IsolationForest()).fit(normal_only(with_type_code(readings)), feature_names(), by)


def score_forest(model: IsolationForestModel, readings: DataFrame) -> DataFrame:
    """Readings with `iforest_score` and `predicted_failure`."""
    return model.score(with_type_code(readings))


def forest_report(
    scored: DataFrame, labels: Sequence[str], truth: str = "machine_failure", score: str = "iforest_score"
) -> dict[str, DataFrame]:
    """AUC, average precision, confusion counts, class report and detection per mode of scored rows."""
    curve = metrics.score_cumulative(scored, score, truth)
    return {
        "roc_auc": metrics.roc_auc(curve),
        "average_precision": metrics.average_precision(curve),
        "confusion": metrics.confusion(scored, truth),
        "report": metrics.classification_report(scored, truth),
        "detection": detection_by_mode(scored, labels),
    }


@dataclass(frozen=True)
class FailureModels:
    """Scaling and models that belong together, with the frame length they expect."""

    scaling: ZScore
    models: MultiLabelModel
    size: int

    def score(self, frames: DataFrame) -> DataFrame:
        return self.models.score(apply_zscore(frames, self.scaling))

    def save(self, spark: SparkSession, path: str) -> None:
        self.models.save(spark, f"{path}/models")
        self.scaling.save(spark, f"{path}/scaling", self.size)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FailureModels:
        scaling, size = ZScore.load(spark, f"{path}/scaling")
        return FailureModels(scaling, MultiLabelModel.load(spark, f"{path}/models"), size)


def failure_frames(
    readings: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    by: Sequence[str],
    truth: str = "machine_failure",
    size: int = 20,
    ratio: float = 0.2,
    seed: int = 42,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Training frames with their `split`, stratified by the failure flag.

    The frames are stored, because the fits read them many times.
    """
    framed = lag_windows(with_type_code(readings), keys, order, feature_names(), size, rows_per_slice)
    return cut_lineage(stratified_split(framed, truth, by, ratio, seed))


def fit_failure_models(frames: DataFrame, labels: Sequence[str], size: int = 20, max_iter: int = 50) -> FailureModels:
    """Scaling and models from the training part alone."""
    train = frames.filter(F.col("split") == "train")
    scaling = fit_zscore(train, len(feature_names()))
    return FailureModels(scaling, fit_multilabel(apply_zscore(train, scaling), labels, max_iter), size)


def failure_report(
    scored: DataFrame, labels: Sequence[str], truth: str = "machine_failure"
) -> dict[str, DataFrame]:
    """Per-label report, macro AUC over the labels that have one, any-failure report, F1 at 0.5."""
    pairs = {label: (f"prob_{label}", label) for label in labels}
    long = metrics.long_form(scored, pairs)
    per_label = metrics.per_label_report(long)
    return {
        "per_label": per_label,
        "auc_macro": metrics.macro_mean(per_label, "auc"),
        "any_failure": metrics.any_failure_report(scored, [f"prob_{label}" for label in labels], truth),
        "f1": metrics.f1_per_label(long),
        "f1_macro": metrics.f1_macro(long),
    }


def scene_rows(
    scenes: DataFrame,
    system_text: str,
    user_text: str,
    ratio: float = 0.2,
    seed: int = 42,
    large_pictures: bool = False,
) -> DataFrame:
    """Chat rows of all scenes with their `split`, stratified by category."""
    labelled = label_rows(build_labels(scenes, large_pictures))
    return build_chat_rows(stratified_split(labelled, "category", ["scene_id"], ratio, seed), system_text, user_text)
