"""Sliced work must equal the plain window on one partition."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plantwatch.operators import episodes
from plantwatch.operators import ordered as o

ORDER = ["t", "id"]


@pytest.fixture(scope="module")
def series(spark):
    """6000 rows: one key with two thirds of them, a thin one, NULL keys, repeated order values."""
    key = "CASE WHEN id % 3 <> 0 THEN 'hot' WHEN id % 100 = 0 THEN NULL WHEN id % 50 = 3 THEN concat('k', id % 2000) ELSE 'b' END"
    return spark.range(6000).selectExpr(
        "id * id % 997 * 3 + id % 3 AS t", "id", f"{key} AS k", "CAST(id * 7 % 1000 AS DOUBLE) / 1000 AS x"
    ).cache()


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("rows", [150, 500, 10**6])
def test_positions(series, keys, rows):
    got = o.with_position(series, keys, ORDER, rows_per_slice=rows)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER)) - 1
    assert same(got, series.withColumn("position", place.cast("long")))


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("rows", [60, 300])
def test_frames(series, keys, rows):
    span = Window.partitionBy(*keys).orderBy(*ORDER)
    row = F.array("x")
    for cut, lo, hi in ((o.lag_windows, -20, -1), (o.trailing_frames, -19, 0)):
        expected = series.withColumn("frame", F.collect_list(row).over(span.rowsBetween(lo, hi))).filter("size(frame) = 20")
        assert same(cut(series, keys, ORDER, ["x"], 20, rows_per_slice=rows), expected)


def test_global_frames_count(spark):
    rows = spark.range(10000).selectExpr("id", "CAST(id AS DOUBLE) AS x")
    assert o.lag_windows_bucketed(rows, ["id"], ["x"], 20, rows_per_slice=500).count() == 9980


@pytest.mark.parametrize("n, frames", [(20, 0), (21, 1)])
def test_frames_need_a_full_past(spark, n, frames):
    rows = spark.range(n).selectExpr("id", "CAST(id AS DOUBLE) AS x")
    assert o.lag_windows(rows, [], ["id"], ["x"], 20).count() == frames


def test_running(series):
    values = {"s": ("sum", F.col("x")), "top": ("max", F.col("x")), "low": ("min", F.col("x"))}
    got = o.running(o.slice_rows(series, ["k"], ORDER, 91), values, whole=["low"], before=["top"]).rows()
    w = Window.partitionBy("k").orderBy(*ORDER)
    expected = (
        series.withColumn("s", F.sum("x").over(w))
        .withColumn("top", F.max("x").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("low", F.min("x").over(w))
        .withColumn("low_all", F.min("x").over(Window.partitionBy("k")))
    )
    rounded = lambda df: df.withColumn("s", F.round("s", 6))
    assert same(rounded(got), rounded(expected))


def test_unknown_order_values(spark):
    rows = spark.range(400).selectExpr(
        "id", "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN DOUBLE('NaN') ELSE CAST(id * 13 % 101 AS DOUBLE) END AS t"
    )
    got = o.with_position(rows, [], ORDER, rows_per_slice=20)
    place = F.row_number().over(Window.partitionBy().orderBy(*ORDER)) - 1
    assert same(got.drop("t"), rows.withColumn("position", place.cast("long")).drop("t"))


@pytest.mark.parametrize("n", [3, 1500])
def test_last_n(series, n):
    w = Window.partitionBy("k").orderBy(F.desc("t"), F.desc("id"))
    expected = series.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)
    assert same(o.last_n(series, ["k"], ORDER, n), expected)


def test_no_task_holds_a_large_key(series):
    sizes = o.slice_rows(series, ["k"], ORDER, 300).df.groupBy("k", o.SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] <= 600
    slices = {r.k: r["count"] for r in sizes.groupBy("k").count().collect()}
    # 4000 rows need 14 slices; keys below the limit stay whole.
    assert 10 <= slices["hot"] <= 14
    small = series.groupBy("k").count().filter("count <= 300").collect()
    assert small and all(slices[r.k] == 1 for r in small)


def test_large_keys_at_different_times_are_all_sliced(spark):
    rows = spark.range(20_000).selectExpr("id", "id AS t", "concat('k', id DIV 1000) AS k")
    sizes = o.slice_rows(rows, ["k"], ORDER, 100).df.groupBy("k", o.SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] <= 300
    assert sizes.groupBy("k").count().agg(F.min("count")).first()[0] >= 6


def test_small_keys_are_not_sliced(series):
    sliced = o.slice_rows(series, ["k"], ORDER, 4000)
    assert sliced.single and sliced.df.select(o.SLICE).distinct().count() == 1
    assert not o.slice_rows(series, [], ORDER, 4000).single


def test_many_large_keys(series):
    got = o.with_position(series, ["k"], ORDER, rows_per_slice=50)
    place = F.row_number().over(Window.partitionBy("k").orderBy(*ORDER)) - 1
    assert same(got, series.withColumn("position", place.cast("long")))


@pytest.mark.parametrize("time", ["TIMESTAMP'2024-01-01'", "CAST(NULL AS TIMESTAMP)", "IF(id % 2 = 0, NULL, DOUBLE('NaN'))", "'same'"])
def test_rows_of_one_time_are_parted_by_their_number(spark, time):
    """One repeated time, or none at all: the splitters are whole tuples."""
    rows = spark.range(3000).selectExpr("id", f"{time} AS t", "CAST(id AS DOUBLE) AS x")
    sliced = o.slice_rows(rows, [], ORDER, 250)
    assert sliced.df.groupBy(o.SLICE).count().agg(F.max("count")).first()[0] <= 500
    got = o.lag_windows(rows, [], ORDER, ["x"], 20, rows_per_slice=250)
    plain = rows.withColumn("frame", F.collect_list(F.array("x")).over(Window.orderBy(*ORDER).rowsBetween(-20, -1))).filter("size(frame) = 20")
    assert same(got.drop("t"), plain.drop("t"))


def test_order_without_variety_stays_whole(spark):
    rows = spark.range(100).selectExpr("id", "0 AS t")
    got = o.with_position(rows, [], ORDER, rows_per_slice=10)
    assert got.filter("position <> id").count() == 0


def test_timeline_across_slices(series):
    wide = episodes.score_timeline(series, ["k"], ORDER, score="x", rows_per_slice=17)
    assert same(wide, episodes.score_timeline(series, ["k"], ORDER, score="x"))


def test_timeline_by_hand(spark):
    scores = [0.30, 0.20, 0.40, 0.60, 0.70, 0.90, 0.50, 0.66]
    rows = spark.createDataFrame([("n", i, s) for i, s in enumerate(scores)], "k string, i int, anomaly_score double")
    for size in (2, 3, 100):
        got = episodes.rise_kind(episodes.score_timeline(rows, ["k"], ["i"], rows_per_slice=size)).first()
        assert (got.base_score, got.rise_start.i, got.crossing.i, got.rise_rows) == (0.30, 1, 4, 3)
        assert (got.peak_score, got.peak.i, got.rise, got.readings) == (0.90, 5, "abrupt", 8)


def test_timeline_without_crossing(spark):
    rows = spark.createDataFrame([("n", 1, 0.1), ("n", 2, 0.2)], "k string, i int, anomaly_score double")
    got = episodes.rise_kind(episodes.score_timeline(rows, ["k"], ["i"])).first()
    assert got.crossing is None and got.rise_start is None and got.rise is None
