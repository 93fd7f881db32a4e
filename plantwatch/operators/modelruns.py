"""Scoring stored model answers against the truth, and comparing runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantwatch.functions.jsontext import extract_json, field_text, has_field, same_field

VALIDITY = ("valid_json", "fields_present")


def score_fields(outputs: DataFrame, fields: Sequence[str], raw: str = "raw", truth: str = "truth") -> DataFrame:
    """Add `pred` and 0/1 columns: valid_json, fields_present, and one per field.

    `raw` is the answer text, `truth` the JSON text of the truth. A field counts when its value is
    equal by JSON value; a missing field or answer counts 0.
    """
    parsed = outputs.withColumn("pred", extract_json(F.col(raw))).withColumn("_truth", F.try_parse_json(truth))
    present = reduce(lambda a, b: a & b, [has_field(F.col("pred"), f) for f in fields])
    return parsed.withColumns(
        {
            "valid_json": F.col("pred").isNotNull().cast("int"),
            "fields_present": F.coalesce(present.cast("int"), F.lit(0)),
            **{f: same_field(F.col("pred"), F.col("_truth"), f) for f in fields},
        }
    ).drop("_truth")


def run_summary(scored: DataFrame, fields: Sequence[str], run: str = "run", latency: str = "latency_s") -> DataFrame:
    """One row per run: n, mean latency, overall accuracy over the fields, mean per field.

    The validity columns are averaged but do not enter the overall accuracy; a failed call counts
    with the latency it was stored with.
    """
    hits = reduce(add, [F.col(f) for f in fields])
    return scored.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(latency).alias("avg_latency_s"),
        (F.sum(hits.cast("long")) / (F.count(F.lit(1)) * len(fields))).alias("overall"),
        *[F.avg(f).alias(f) for f in (*VALIDITY, *fields)],
    )


def compare_runs(summary: DataFrame, runs: Sequence[str], run: str = "run") -> DataFrame:
    """One row per measure with a column per run, 0 where a run lacks it, and the last minus the first."""
    measures = [c for c in summary.columns if c != run]
    long = summary.select(run, *[F.col(c).cast("double").alias(c) for c in measures]).unpivot(
        [run], measures, "measure", "value"
    )
    table = long.groupBy("measure").pivot(run, list(runs)).agg(F.first("value"))
    filled = table.select("measure", *[F.coalesce(F.col(f"`{r}`"), F.lit(0.0)).alias(r) for r in runs])
    return filled.withColumn("delta", F.col(f"`{runs[-1]}`") - F.col(f"`{runs[0]}`"))


def latency_stats(outputs: DataFrame, run: str = "run", latency: str = "latency_s") -> DataFrame:
    return outputs.groupBy(run).agg(
        F.avg(latency).alias("avg_s"), F.min(latency).alias("min_s"), F.max(latency).alias("max_s")
    )


def errors_by_field(scored: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(field, errors, accuracy) per group."""
    return (
        scored.select(*by, *fields)
        .unpivot(list(by), list(fields), "field", "_hit")
        .groupBy(*by, "field")
        .agg(
            F.sum((F.col("_hit") == 0).cast("long")).alias("errors"),
            (1 - F.sum((F.col("_hit") == 0).cast("long")) / F.count(F.lit(1))).alias("accuracy"),
        )
    )


def field_confusion(
    scored: DataFrame, field: str, truth: str = "truth", by: Sequence[str] = ()
) -> DataFrame:
    """True and predicted values of the rows where a field is wrong, with counts; missing is "None"."""

    def shown(value: Column) -> Column:
        return F.coalesce(field_text(value, field), F.lit("None"))

    # Counted over all rows and filtered afterwards: a filter on the comparison would be pushed
    # below the parsing, and every answer parsed once more.
    return (
        scored.groupBy(
            *by,
            shown(F.try_parse_json(truth)).alias("true_value"),
            shown(F.col("pred")).alias("predicted_value"),
        )
        .agg(F.count_if(F.col(field) == 0).alias("n"))
        .filter(F.col("n") > 0)
    )
