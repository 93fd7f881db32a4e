"""Counts, distributions and averages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.functions.numbers import report_round, safe_ratio
from plantwatch.local import local_table


def dataset_summary(df: DataFrame, labels: Sequence[str], target: str = "machine_failure") -> DataFrame:
    """Rows, normal rows, failures and cases per label with their share of all rows, as (item, n, pct)."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((F.col(target) == 0).cast("long")).alias("normal"),
        F.sum((F.col(target) != 0).cast("long")).alias("failures"),
        *[F.sum(F.col(label).cast("long")).alias(label) for label in labels],
    )
    items = ["total", "normal", "failures", *labels]
    return (
        counts.withColumn("_total", F.col("total"))
        .unpivot(["_total"], items, "item", "n")
        .select(
            "item",
            F.coalesce("n", F.lit(0)).alias("n"),
            report_round(safe_ratio(F.col("n") * 100.0, F.col("_total")), 2).alias("pct"),
        )
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def category_distribution(df: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Counts over a fixed order of categories per column, zeros included."""
    wanted = local_table(
        df.sparkSession,
        [(column, i, value) for column, values in categories.items() for i, value in enumerate(values)],
        "field string, ordinal int, category string",
    )
    counts = (
        df.select(*[F.col(c).cast("string").alias(c) for c in categories])
        .unpivot([], list(categories), "field", "category")
        .groupBy("field", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return wanted.join(counts, ["field", "category"], "left").select(
        "field", "ordinal", "category", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def class_histogram(df: DataFrame, value: str, label: str, bins_by_class: Mapping[int, int]) -> DataFrame:
    """Density histogram per class over the class's own range, in equal bins, the last one closed.

    Returns every bin, also an empty one, with its edges, count and density.
    """
    bins = local_table(df.sparkSession, list(bins_by_class.items()), f"{label} int, bins int")
    known = df.select(label, F.col(value).cast("double").alias("_x")).filter(
        F.col("_x").isNotNull() & ~F.isnan("_x")
    )
    limits = known.groupBy(label).agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    # A class with one value gets a range of width 1 around it.
    flat = F.col("_lo") == F.col("_hi")
    limits = limits.join(bins, label).select(
        label,
        "bins",
        "_n",
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    # One row per class named in `bins_by_class`, so the size of this side is the caller's choice.
    limits = F.broadcast(limits.withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.col("bins")))

    def edge(i):
        return F.when(i == F.col("bins"), F.col("_hi")).otherwise(F.col("_lo") + i * F.col("_step"))

    raw = F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("bins")).cast("int")
    clipped = F.least(raw, F.col("bins") - 1)
    # The division may miss an edge by one bit; the edges decide.
    settled = (
        F.when(F.col("_x") < edge(F.col("_b")), F.col("_b") - 1)
        .when((F.col("_b") < F.col("bins") - 1) & (F.col("_x") >= edge(F.col("_b") + 1)), F.col("_b") + 1)
        .otherwise(F.col("_b"))
    )
    counts = (
        known.join(limits, label)
        .withColumn("_b", clipped)
        .withColumn("bin", settled)
        .groupBy(label, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    return grid.join(counts, [label, "bin"], "left").select(
        label,
        "bin",
        edge(F.col("bin")).alias("left_edge"),
        edge(F.col("bin") + 1).alias("right_edge"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        (F.coalesce("n", F.lit(0)) / (F.col("_n") * F.col("_step"))).alias("density"),
    )


def detection_by_mode(df: DataFrame, labels: Sequence[str], predicted: str = "predicted_failure") -> DataFrame:
    """Per label: cases, detected cases and their rate; labels without cases are left out."""
    return (
        df.select(F.col(predicted).alias("_hit"), *[F.col(c).cast("int").alias(c) for c in labels])
        .unpivot(["_hit"], list(labels), "mode", "_case")
        .filter(F.col("_case") == 1)
        .groupBy("mode")
        .agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("_hit").cast("long")).alias("detected"))
        .withColumn("rate", report_round(F.col("detected") / F.col("total"), 3))
    )


def elementwise_mean(df: DataFrame, group: Sequence[str], column: str) -> DataFrame:
    """Mean per position over equal-length arrays, as one array per group."""
    # One row per (group, position) leaves the partial aggregate; the list is as long as the arrays.
    per_position = (
        df.select(*group, F.posexplode(column).alias("_pos", "_x"))
        .groupBy(*group, "_pos")
        .agg(F.avg(F.col("_x").cast("double")).alias("_mean"))
    )
    means = F.array_sort(F.collect_list(F.struct("_pos", "_mean")))
    return per_position.groupBy(*group).agg(F.transform(means, lambda m: m["_mean"]).alias("mean"))


def random_sample(df: DataFrame, n: int, by: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows drawn by an MD5 of the identifying columns and the seed: the same rows on every run, and in any engine."""
    draw = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in by], F.lit(str(seed))).cast("binary"))
    return df.orderBy(draw, *by).limit(n)
