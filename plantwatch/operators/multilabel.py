"""One weighted binary model per failure mode on flattened frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.functions.rules import FAILURE_PROBABILITY, anomaly_score, predicted_failure
from plantwatch.local import local_table
from plantwatch.operators.prep import positive_weights
from plantwatch.session import cut_lineage

VECTOR = "_vector"
ROW_GROUP = 8 << 20


def complete(frame: str = "frame") -> Column:
    """Whether every sensor of every row of the frame is known."""
    return F.forall(F.flatten(frame), lambda v: v.isNotNull() & ~F.isnan(v))


def flattened(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """The frame as one vector; zeros stand in where a sensor is unknown, so that the row can be carried along."""
    values = F.transform(F.flatten(frame), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    return frames.withColumn(VECTOR, array_to_vector(values))


@dataclass(frozen=True)
class MultiLabelModel:
    """Model per label, in the order of the labels."""

    models: dict[str, LogisticRegressionModel]

    def score(self, frames: DataFrame, threshold: float = FAILURE_PROBABILITY) -> DataFrame:
        """Add `prob_<label>`, `anomaly_score` (the largest) and `predicted_failure`.

        They are NULL for a frame with an unknown sensor.
        """
        scored = flattened(frames)
        names = []
        for label, model in self.models.items():
            one = model.copy().setFeaturesCol(VECTOR).setProbabilityCol("_p")
            one = one.setRawPredictionCol("").setPredictionCol("")
            name = f"prob_{label}"
            scored = one.transform(scored).withColumn(name, F.when(complete(), F.get(vector_to_array("_p"), F.lit(1)))).drop("_p")
            names.append(name)
        top = anomaly_score([F.col(n) for n in names])
        return scored.drop(VECTOR).withColumn("anomaly_score", top).withColumn(
            "predicted_failure", predicted_failure(F.col("anomaly_score"), threshold)
        )


    def save(self, spark: SparkSession, path: str) -> None:
        """Write one model per label, and the order of the labels."""
        order = local_table(spark, list(enumerate(self.models)), "place int, label string")
        order.coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")
        for label, model in self.models.items():
            model.write().overwrite().save(f"{path}/label={label}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> MultiLabelModel:
        labels = [r["label"] for r in spark.read.parquet(f"{path}/labels").orderBy("place").collect()]
        return MultiLabelModel({x: LogisticRegressionModel.load(f"{path}/label={x}") for x in labels})


def fit_multilabel(
    frames: DataFrame, labels: Sequence[str], max_iter: int = 50, reg: float = 1e-4
) -> MultiLabelModel:
    """Fit the labels on scaled frames; positives weigh as much as the negatives of their label.

    A label without a case gets a model that always answers 0. Frames with an unknown sensor are left out.
    """
    # Every fit reads the vectors twice and then holds its own blocks of them, so the vectors are stored and not held a second time.
    # Small row groups are shared out evenly, however the frames were.
    training = cut_lineage(flattened(frames.filter(complete())).select(VECTOR, *labels), **{"parquet.block.size": str(ROW_GROUP)})
    weights = {r["label"]: r["weight"] for r in positive_weights(training, labels).collect()}
    models = {}
    for label in labels:
        weighted = training.select(
            VECTOR,
            F.col(label).cast("double").alias("label"),
            F.when(F.col(label) == 1, F.lit(float(weights[label]))).otherwise(F.lit(1.0)).alias("weight"),
        )
        estimator = LogisticRegression(
            featuresCol=VECTOR, labelCol="label", weightCol="weight", family="binomial", maxIter=max_iter, regParam=reg
        )
        models[label] = estimator.fit(weighted)
    return MultiLabelModel(models)
