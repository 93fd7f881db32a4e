"""Fitted models. Their results have no SQL form; what SQL can say of samples, splits, cuts and shuffles has."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch.functions.numbers import report_round
from plantwatch.operators import forest, metrics, ordered
from plantwatch.operators.filters import feature_names, normal_only
from plantwatch.plans import training
from plantwatch.registry.book import register
from plantwatch.registry.frames import LABELS, ORDER

FOREST = forest.IsolationForest(contamination=0.034)


def _forest_scores(readings):
    model = training.fit_forest(readings, ["reading_id"], FOREST)
    scored = training.score_forest(model, readings.drop("predicted_failure"))
    return scored.select("reading_id", "machine_failure", "iforest_score", "predicted_failure")


register("isolation_forest", ["readings"])(_forest_scores)

register("isolation_forest_report", ["readings"])(
    lambda r: metrics.classification_report(_forest_scores(r))
)


def _importance(readings):
    model = training.fit_forest(readings, ["reading_id"], FOREST)
    return forest.permutation_importance(
        training.with_type_code(readings), model.score_column, feature_names(), ["reading_id"]
    ).withColumn("importance", report_round(F.col("importance"), 6))


register("permutation_importance", ["readings"])(_importance)


def _multilabel(cases):
    plain = cases.drop("anomaly_score", "predicted_failure", *[f"prob_{x}" for x in LABELS])
    frames = training.failure_frames(plain, ["node_id"], ORDER, ["reading_id"])
    models = training.fit_failure_models(frames, LABELS)
    return models.score(frames.filter(F.col("split") == "test"))


register("multilabel", ["cases"])(
    lambda c: _multilabel(c).select(
        "reading_id", "machine_failure", *[f"prob_{x}" for x in LABELS], "anomaly_score", "predicted_failure"
    )
)

register("failure_report", ["cases"])(lambda c: training.failure_report(_multilabel(c), LABELS)["per_label"])

# Every tree draws exactly its sample, or all rows of a smaller table.
register("forest_samples", ["readings"], """
SELECT CAST(tree AS INT) AS tree, least(256, (SELECT count(*) FROM readings WHERE machine_failure = 0)) AS n, CAST(least(256,
  (SELECT count(*) FROM readings WHERE machine_failure = 0)) AS BIGINT) AS different FROM range(200) t(tree)
""")(
    lambda r: FOREST.samples(
        normal_only(training.with_type_code(r)), ["reading_id"], feature_names(), normal_only(r).count()
    )
    .groupBy("tree")
    .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("draw").alias("different"))
)


@register("forest_cut", ["readings"], """
SELECT CAST(count(*) AS BIGINT) AS normal, true AS within, true AS between FROM readings WHERE machine_failure = 0
""")
def _cut(readings):
    """The cut leaves the contamination of the normal rows above it, ties aside, and all scores lie in its reach."""
    scored = _forest_scores(readings).filter(F.col("machine_failure") == 0)
    flagged = F.sum("predicted_failure")
    most = F.ceil(F.count(F.lit(1)) * F.lit(FOREST.contamination))
    return scored.agg(
        F.count(F.lit(1)).alias("normal"), ((flagged > 0) & (flagged <= most)).alias("within"),
        ((F.min("iforest_score") > -1) & (F.max("iforest_score") < 1)).alias("between"),
    )


register("shuffled_places", ["readings"], """
SELECT CAST(count(*) AS BIGINT) AS places, CAST(count(*) AS BIGINT) AS taken, CAST(0 AS BIGINT) AS first, CAST(count(*) - 1 AS BIGINT) AS last FROM readings
""")(
    lambda r: ordered.with_position(r.select("reading_id"), [], ["reading_id"], "place")
    .select(forest.shuffled(F.col("place"), r.count(), 42).alias("to"))
    .agg(F.count(F.lit(1)).alias("places"), F.countDistinct("to").alias("taken"), F.min("to").alias("first"), F.max("to").alias("last"))
)

# What the sequence models learn from and are judged on.
register("training_frames", ["cases"], """
, f AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY event_ts, reading_id) AS pos FROM cases),
n AS (SELECT machine_failure, count(*) AS n, CAST(round_even(count(*) * 0.2e0, 0) AS BIGINT) AS t FROM f WHERE pos > 20 GROUP BY machine_failure)
SELECT machine_failure, 'test' AS split, t AS frames, CAST(20 * t AS BIGINT) AS rows FROM n WHERE t > 0
UNION ALL SELECT machine_failure, 'train', n - t, CAST(20 * (n - t) AS BIGINT) FROM n WHERE n > t
""")(
    lambda c: training.failure_frames(c, ["node_id"], ORDER, ["reading_id"])
    .groupBy("machine_failure", "split")
    .agg(F.count(F.lit(1)).alias("frames"), F.sum(F.size("frame").cast("bigint")).alias("rows"))
)
