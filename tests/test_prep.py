"""Splits, scaling, weights, operating points."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwatch.operators import ordered, prep


def strata(spark, **sizes):
    rows = [(s, i) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "category string, id long")


def counts(split):
    return {(r.category, r.split): r["count"] for r in split.groupBy("category", "split").count().collect()}


def test_split_sizes(spark):
    got = counts(prep.stratified_split(strata(spark, fire=622, none=116), "category", ["id"]))
    assert got == {("fire", "test"): 124, ("fire", "train"): 498, ("none", "test"): 23, ("none", "train"): 93}


def test_split_of_tiny_strata(spark):
    got = counts(prep.stratified_split(strata(spark, a=1, b=2, c=3, d=13), "category", ["id"]))
    # 0.2, 0.4, 0.6 and 2.6 rows; a half goes to the even number.
    assert got == {("a", "train"): 1, ("b", "train"): 2, ("c", "test"): 1, ("c", "train"): 2, ("d", "test"): 3, ("d", "train"): 10}


def test_split_does_not_depend_on_the_layout(spark):
    df = strata(spark, fire=622, none=116)
    first = prep.stratified_split(df, "category", ["id"])
    second = prep.stratified_split(df.repartition(7, "id"), "category", ["id"])
    assert first.exceptAll(second).count() == 0
    other = prep.stratified_split(df, "category", ["id"], seed=7)
    assert first.exceptAll(other).count() > 0


def test_split_takes_the_lowest_hashes(spark):
    df = strata(spark, hot=3000, cold=50)
    split = prep.stratified_split(df, "category", ["id"]).withColumn("h", F.xxhash64("id", F.lit(42)))
    edges = split.groupBy("category").agg(
        F.max(F.when(F.col("split") == "test", F.col("h"))).alias("hi"),
        F.min(F.when(F.col("split") == "train", F.col("h"))).alias("lo"),
    )
    assert all(r.hi < r.lo for r in edges.collect())


def test_split_with_unknown_stratum(spark):
    df = spark.range(100).withColumn("category", F.when(F.col("id") < 50, "a"))
    got = counts(prep.stratified_split(df, "category", ["id"]))
    assert got[("a", "test")] == 10 and got[(None, "test")] == 10


@pytest.mark.parametrize("rows_per_slice", [1, 40, 10**6])
def test_split_descends_into_crowded_bands(spark, monkeypatch, rows_per_slice):
    """Hashes that share their first 48 bits: the band is counted again by the next 16, down to single hashes."""
    df = strata(spark, hot=900, cold=70)
    crowded = lambda *c: F.shiftright(inner(*c), 58)
    inner = F.xxhash64
    monkeypatch.setattr(prep.F, "xxhash64", crowded)
    split = prep.stratified_split(df, "category", ["id"], rows_per_slice=rows_per_slice)
    monkeypatch.undo()
    assert counts(split) == {("hot", "test"): 180, ("hot", "train"): 720, ("cold", "test"): 14, ("cold", "train"): 56}
    key = F.struct(F.shiftright(inner("id", F.lit(42)), 58).alias("h"), "id")
    edges = split.withColumn("k", key).groupBy("category").agg(F.max(F.when(F.col("split") == "test", F.col("k"))).alias("hi"), F.min(F.when(F.col("split") == "train", F.col("k"))).alias("lo"))
    assert all(tuple(r.hi) < tuple(r.lo) for r in edges.collect())


@pytest.mark.parametrize("trailing", [False, True])
@pytest.mark.parametrize("rows_per_slice", [30, 10**6])
def test_weights_count_the_frames_of_a_row(spark, trailing, rows_per_slice):
    """Weighted moments equal those over all rows of all frames."""
    rows = spark.range(200).selectExpr("id", "id % 3 + IF(id < 90, 0, 3) AS k", "IF(id % 11 = 0, NULL, CAST(id * 37 % 101 AS DOUBLE) + 1e6) AS x", "CAST(id AS DOUBLE) AS y")
    cut = ordered.trailing_frames if trailing else ordered.lag_windows
    frames = cut(rows, ["k"], ["id"], ["x", "y"], 7)
    flat = [r for f in frames.collect() for r in f.frame]
    weighted = prep.frame_weights(rows, ["k"], ["id"], 7, rows_per_slice, trailing)
    assert weighted.count() == 200 and weighted.agg(F.sum("weight")).first()[0] == len(flat)
    for stats in (prep.weighted_stats(weighted.repartition(5), ["x", "y"]), prep.zscore_stats(frames.repartition(3))):
        got = {r.feature: (r["mean"], r["std"]) for r in stats.collect()}
        for i in (0, 1):
            values = [r[i] for r in flat if r[i] is not None]
            assert math.isclose(got[i][0], np.mean(values), rel_tol=1e-12)
            assert math.isclose(got[i][1], np.std(values) + 1e-8, rel_tol=1e-9)


def test_weights_need_no_explode(spark):
    rows = spark.range(200).selectExpr("id", "CAST(id AS DOUBLE) AS x")
    plan = prep.weighted_stats(prep.frame_weights(rows, [], ["id"], 7), ["x"])._jdf.queryExecution().toString()
    assert "Generate" not in plan


def test_zscore(spark):
    frames = spark.createDataFrame([([[1.0, 10.0], [3.0, 10.0]],), ([[5.0, 10.0], [7.0, 10.0]],)], "frame array<array<double>>")
    scaling = prep.fit_zscore(frames, 2)
    assert scaling.mean == (4.0, 10.0)
    assert math.isclose(scaling.std[0], np.std([1, 3, 5, 7]) + 1e-8)
    assert scaling.std[1] == 1e-8
    scaled = prep.apply_zscore(frames, scaling).first().frame
    assert math.isclose(scaled[0][0], -3 / (np.std([1, 3, 5, 7]) + 1e-8)) and scaled[0][1] == 0.0


def test_positive_weights(spark):
    df = spark.createDataFrame([(1, 0)] * 2 + [(0, 0)] * 8, "a int, b int")
    got = {r.label: (r.positives, r.weight) for r in prep.positive_weights(df, ["a", "b"]).collect()}
    assert got == {"a": (2, 4.0), "b": (1, 9.0)}


@pytest.mark.parametrize("contamination", [0.034, 0.01, 0.5])
@pytest.mark.parametrize("distinct", [7, 10**6])
def test_operating_point_is_the_exact_percentile(spark, contamination, distinct):
    rows = spark.range(1001).select((F.pmod(F.xxhash64("id"), F.lit(distinct)) / 1000.0).alias("s"))
    values = np.array([r.s for r in rows.collect()])
    got = prep.operating_point(rows, "s", contamination, rows_per_slice=50).first()
    assert math.isclose(got.threshold, np.percentile(values, 100 * (1 - contamination)), abs_tol=1e-9)
    assert got.flagged == int((values > got.threshold + 1e-12).sum())
