"""Counts and distributions against numpy and by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwatch.operators import summaries


@pytest.mark.parametrize("values", [[0.1 * i for i in range(101)], [5.0] * 7, [0.0, 1.0], [x / 7 for x in range(-30, 300, 7)]])
@pytest.mark.parametrize("bins", [1, 10, 50])
def test_histogram_equals_numpy(spark, values, bins):
    df = spark.createDataFrame([(v, 0) for v in values] + [(None, 0), (float("nan"), 0), (3.0, 9)], "x double, y int")
    got = summaries.class_histogram(df, "x", "y", {0: bins}).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=bins)
    density, _ = np.histogram(values, bins=bins, density=True)
    assert [r.n for r in got] == counts.tolist()
    assert np.allclose([r.left_edge for r in got] + [got[-1].right_edge], edges)
    assert np.allclose([r.density for r in got], density)


def test_histogram_per_class(spark):
    df = spark.createDataFrame([(0.0, 0), (10.0, 0), (100.0, 1), (200.0, 1)], "x double, y int")
    got = summaries.class_histogram(df, "x", "y", {0: 2, 1: 4}).collect()
    assert {(r.y, r.left_edge) for r in got} == {(0, 0.0), (0, 5.0), (1, 100.0), (1, 125.0), (1, 150.0), (1, 175.0)}


def test_summary(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (0, 0, 0), (0, 0, 0)], "machine_failure int, twf int, hdf int")
    got = {r["item"]: (r.n, r.pct) for r in summaries.dataset_summary(df, ["twf", "hdf"]).collect()}
    assert got == {"total": (4, 100.0), "normal": (3, 75.0), "failures": (1, 25.0), "twf": (1, 25.0), "hdf": (0, 0.0)}


def test_summary_of_nothing(spark):
    df = spark.createDataFrame([], "machine_failure int, twf int")
    got = {r["item"]: (r.n, r.pct) for r in summaries.dataset_summary(df, ["twf"]).collect()}
    assert got == {"total": (0, 0.0), "normal": (0, 0.0), "failures": (0, 0.0), "twf": (0, 0.0)}


def test_categories_without_rows_count_zero(spark):
    df = spark.createDataFrame([("low",), ("low",), ("odd",)], "level string")
    got = summaries.category_distribution(df, {"level": ["none", "low"]}).orderBy("ordinal").collect()
    assert [(r.category, r.n) for r in got] == [("none", 0), ("low", 2)]


def test_detection(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (1, 0, 1), (0, 0, 1)], "twf int, hdf int, predicted_failure int")
    got = summaries.detection_by_mode(df, ["twf", "hdf"]).collect()
    assert [(r["mode"], r.total, r.detected, r.rate) for r in got] == [("twf", 3, 2, 0.667)]


def test_elementwise_mean(spark):
    rows = np.random.default_rng(0).normal(size=(30, 7))
    df = spark.createDataFrame([(i % 2, r.tolist()) for i, r in enumerate(rows)], "g int, v array<double>").repartition(5)
    got = {r.g: r["mean"] for r in summaries.elementwise_mean(df, ["g"], "v").collect()}
    for g in (0, 1):
        assert np.allclose(got[g], rows[g::2].mean(axis=0))


def test_sample_is_stable(spark):
    df = spark.range(1000)
    first = {r.id for r in summaries.random_sample(df, 10, ["id"]).collect()}
    again = {r.id for r in summaries.random_sample(df.repartition(7), 10, ["id"]).collect()}
    other = {r.id for r in summaries.random_sample(df, 10, ["id"], seed=1).collect()}
    assert first == again and len(first) == 10 and first != other


def test_value_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "v string")
    got = [(r.v, r.n) for r in summaries.value_counts(df, "v").collect()]
    assert got[0] == ("b", 2) and set(got) == {("a", 1), ("b", 2), (None, 1)}
    assert summaries.value_counts(df.select(F.lit(1).alias("v")), "v").first().n == 4
