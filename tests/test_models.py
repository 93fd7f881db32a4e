"""Forest, permutation importance and multi-label models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwatch.operators import forest as f
from plantwatch.operators import metrics, multilabel, ordered, prep
from plantwatch.plans import training


@pytest.fixture(scope="module")
def cloud(spark):
    """3000 points of a cloud and 20 far ones."""
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(0, 1, (3000, 3)), rng.normal(9, 0.5, (20, 3))])
    rows = [(i, *map(float, p), int(i >= 3000)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, odd int").cache()


@pytest.fixture(scope="module")
def model(cloud):
    return f.IsolationForest(n_trees=50, contamination=0.034).fit(cloud.filter("odd = 0"), ["a", "b", "c"], ["id"])


def test_average_path():
    assert f.average_path(1) == 0 and f.average_path(2) == 1
    assert abs(f.average_path(256) - 10.244) < 1e-3


def test_trees_isolate_every_row():
    values = np.random.default_rng(0).normal(size=(64, 2))
    nodes = f.grow_tree(values, 100, np.random.default_rng(1))
    leaves = [n for n in nodes if n[2] == np.inf]
    assert len(leaves) == 64 and all(n[0] == n[3] for n in leaves)


def test_constant_rows_give_one_leaf():
    assert len(f.grow_tree(np.ones((10, 2)), 8, np.random.default_rng(0))) == 1


def test_far_points_score_highest(cloud, model):
    scored = model.score(cloud).select(F.col("iforest_score").alias("score"), F.col("odd").alias("label"))
    assert metrics.roc_auc(metrics.score_cumulative(scored)).first().auc > 0.99


def test_share_of_normals_flagged(cloud, model):
    flagged = model.score(cloud.filter("odd = 0")).agg(F.sum("predicted_failure")).first()[0]
    # 0.034 * 2999 = 101.97, so 102 rows lie above the interpolated cut.
    assert flagged == 102


def test_samples_are_exact(cloud):
    forest = f.IsolationForest(n_trees=30, sample=64)
    sizes = forest.samples(cloud, ["id"], ["a"], 3020).groupBy("tree").count()
    assert {r["count"] for r in sizes.collect()} == {64} and sizes.count() == 30
    small = forest.samples(cloud.limit(10), ["id"], ["a"], 10).groupBy("tree").count()
    assert {r["count"] for r in small.collect()} == {10}


def test_fit_does_not_depend_on_the_layout(cloud, model):
    again = f.IsolationForest(n_trees=50, contamination=0.034).fit(
        cloud.filter("odd = 0").repartition(7), ["a", "b", "c"], ["id"]
    )
    assert np.array_equal(again.feature, model.feature)
    assert np.allclose(again.threshold, model.threshold) and np.isclose(again.cut, model.cut)


def test_missing_feature_has_no_score(cloud, model):
    got = model.score(cloud.limit(1).withColumn("a", F.lit(None).cast("double"))).first()
    assert got.iforest_score is None and got.predicted_failure is None


def test_importance(cloud):
    def score(columns):
        return 3 * columns[0] + columns[1] + 0 * columns[2]

    got = f.permutation_importance(cloud, score, ["a", "b", "c"], ["id"], rows_per_slice=100).collect()
    assert [r.feature for r in got] == ["a", "b", "c"] and got[2].importance == 0
    assert got[0].importance > 2 * got[1].importance > 0


def test_shuffle_is_a_permutation(cloud):
    numbers = ordered.with_position(
        cloud.withColumn("h", F.xxhash64("id", F.lit(42))), [], ["h", "id"], rows_per_slice=100
    )
    assert numbers.agg(F.countDistinct("position"), F.max("position")).first()[:] == (3020, 3019)


def test_multilabel(spark):
    rows = spark.range(600).selectExpr(
        "id", "CAST(id % 10 AS DOUBLE) AS x", "CAST((id - 1) % 10 > 7 AS INT) AS late", "CAST(0 AS INT) AS never"
    )
    frames = ordered.lag_windows(rows, [], ["id"], ["x"], 3)
    scaled = prep.apply_zscore(frames, prep.fit_zscore(frames, 1))
    model = multilabel.fit_multilabel(scaled, ["late", "never"], max_iter=30)
    scored = model.score(scaled)
    assert {"prob_late", "prob_never", "anomaly_score", "predicted_failure"} <= set(scored.columns)
    c = metrics.score_cumulative(scored.select(F.col("prob_late").alias("score"), F.col("late").alias("label")))
    assert metrics.roc_auc(c).first().auc > 0.95
    assert scored.agg(F.max("prob_never")).first()[0] < 0.01


def test_fits_hold_one_copy_of_the_vectors(spark, monkeypatch):
    held = []
    frames = spark.createDataFrame([(i, [[float(i), 1.0]], int(i > 10)) for i in range(20)], "i int, frame array<array<double>>, a int")
    for name in ("persist", "cache"):
        monkeypatch.setattr(type(frames), name, lambda self, *level: held.append(level) or self)
    multilabel.fit_multilabel(frames, ["a"])
    assert not held


def test_numbered_rows_are_read_in_small_groups(spark, monkeypatch):
    stored = []
    keep = f.cut_lineage
    monkeypatch.setattr(f, "cut_lineage", lambda df, **options: stored.append(options) or keep(df, **options))
    df = spark.range(50).selectExpr("id", "CAST(id AS DOUBLE) AS x")
    got = f.permutation_importance(df, lambda c: c[0], ["x"], ["id"]).first()
    assert got.importance > 0 and [int(o["parquet.block.size"]) for o in stored] == [f.ROW_GROUP]


def test_forest_scores_equal_a_plain_walk():
    rng = np.random.default_rng(1)
    nodes = [f.grow_tree(rng.normal(size=(256, 6)), 8, rng) for _ in range(8)]
    roots = np.cumsum([0, *map(len, nodes)])[:-1]
    columns = list(zip(*[(n, c, t, left + r, p) for r, tree in zip(roots, nodes) for n, c, t, left, p in tree]))
    arrays = dict(zip(("feature", "threshold", "left", "path"), map(np.array, columns[1:])))
    model = f.IsolationForestModel(tuple("abcdef"), np.zeros(6), np.ones(6), **arrays, roots=roots, height=8, normal_path=10.0)
    values = rng.normal(size=(20_000, 6))
    plain = []
    for row in values[:50]:
        ends = []
        for at in roots:
            for _ in range(8):
                at = model.left[at] + (row[model.feature[at]] > model.threshold[at])
            ends.append(model.path[at])
        plain.append(2 ** (-sum(ends) / 80))
    assert np.allclose(model.raw_scores(values)[:50], plain, rtol=1e-14) and len(model.raw_scores(values[:0])) == 0


def test_frames_with_unknown_sensors_are_left_out(spark):
    rows = [(i, [[float(i), 1.0]], int(i > 10), i % 2) for i in range(20)]
    rows += [(50, [[None, 1.0]], 1, 0), (51, [[float("nan"), 1.0]], 0, 1)]
    frames = spark.createDataFrame(rows, "i int, frame array<array<double>>, a int, b int")
    model = multilabel.fit_multilabel(frames, ["a", "b"])
    got = {r.i: r.prob_a for r in model.score(frames).collect()}
    assert got[50] is None and got[51] is None and got[19] > 0.5 > got[0]


def test_trees_draw_from_all_rows(spark):
    df = spark.range(400_000).select("id", F.rand(1).alias("x"))
    forest_ = f.IsolationForest(n_trees=20, sample=64)
    got = forest_.samples(df, ["id"], ["x"], 400_000).groupBy("tree").count().collect()
    assert sorted(r["count"] for r in got) == [64] * 20
    drawn = forest_.samples(df, ["id"], ["id", "x"], 400_000).select(F.col("id").cast("long")).distinct()
    assert drawn.where("id < 40000").count() > 60 and drawn.where("id >= 360000").count() > 60


def test_forest_survives_saving(spark, cloud, model, tmp_path):
    model.save(spark, str(tmp_path / "forest"))
    back = f.IsolationForestModel.load(spark, str(tmp_path / "forest"))
    assert back.score(cloud).exceptAll(model.score(cloud)).count() == 0


@pytest.fixture(scope="module")
def machine(spark):
    """2000 readings of four nodes; the tool fails when it is worn."""
    wear = "CAST(id * 13 % 254 AS INT)"
    return spark.range(2000).selectExpr(
        "id AS reading_id", "id AS event_ts", "concat('n', id % 4) AS node_id", "'M' AS product_type",
        "300.0D + id % 5 AS air_temp_k", "310.0D AS process_temp_k", "CAST(1500 + id % 7 AS INT) AS rpm",
        "40.0D + id % 9 AS torque_nm", f"{wear} AS tool_wear_min",
        "CAST((id - 4) * 13 % 254 > 215 AS INT) AS twf", "CAST(id % 97 = 0 AS INT) AS rnf",
    ).withColumn("machine_failure", F.greatest("twf", "rnf"))


def test_failure_models_from_table_to_report(spark, machine, tmp_path):
    labels = ["twf", "rnf"]
    frames = training.failure_frames(machine, ["node_id"], ["event_ts"], ["reading_id"], size=5, rows_per_slice=300)
    assert frames.count() == 2000 - 4 * 5
    fitted = training.fit_failure_models(frames, labels, size=5, max_iter=20)
    test = frames.filter("split = 'test'")
    report = training.failure_report(fitted.score(test), labels)
    per_label = {r["mode"]: r for r in report["per_label"].collect()}
    assert per_label["twf"].auc > 0.95 and per_label["twf"].signal == "good"
    assert report["any_failure"].first().auc > 0.8
    assert report["auc_macro"].first().auc_macro is not None
    fitted.save(spark, str(tmp_path / "m"))
    back = training.FailureModels.load(spark, str(tmp_path / "m"))
    assert back.size == 5 and back.scaling == fitted.scaling
    prob = lambda m: m.score(test).select("reading_id", F.round("prob_twf", 9), F.round("prob_rnf", 9))
    assert prob(back).exceptAll(prob(fitted)).count() == 0


def test_forest_from_table_to_report(machine):
    fitted = training.fit_forest(machine, ["reading_id"], f.IsolationForest(n_trees=20, contamination=0.05))
    report = training.forest_report(training.score_forest(fitted, machine), ["twf", "rnf"])
    counts = report["confusion"].first()
    normals = counts.tn + counts.fp
    assert counts.fp == pytest.approx(0.05 * normals, abs=2)
    assert {r["mode"] for r in report["detection"].collect()} == {"twf", "rnf"}
    assert 0 <= report["roc_auc"].first().auc <= 1 and report["average_precision"].first()[0] > 0


def test_scene_rows(spark):
    rows = [("Fire" if i % 2 else "No Fire", f"{i:05d}", [20.0 + 10 * i] * 4, *[[100.0, 180.0, 100.0, 180.0]] * 3) for i in range(20)]
    scenes = spark.createDataFrame(rows, "category string, stem string, celsius array<double>, r array<double>, g array<double>, b array<double>")
    chat = training.scene_rows(scenes, "s", "u")
    assert {r.split: r["count"] for r in chat.groupBy("split").count().collect()} == {"test": 4, "train": 16}
    assert chat.columns == ["scene_id", "split", "messages"]


def test_scores_equal_a_walk_by_hand(cloud, model):
    rows = [(r.a, r.b, r.c) for r in cloud.orderBy("id").limit(20).collect()]

    def path(row, at):
        scaled = (np.array(row) - model.mean) / model.std
        while model.threshold[at] != np.inf:
            at = model.left[at] + int(scaled[model.feature[at]] > model.threshold[at])
        return model.path[at]

    mean_path = [np.mean([path(row, root) for root in model.roots]) for row in rows]
    expected = 2.0 ** (-np.array(mean_path) / f.average_path(256))
    assert np.allclose(model.raw_scores(np.array(rows)), expected)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1009, 20_000])
def test_a_shuffle_uses_every_place_once(spark, n):
    places = spark.range(n).select("id", f.shuffled(F.col("id"), n, 42).alias("to"), f.shuffled(F.col("id"), n, 43).alias("other"))
    got = places.agg(F.countDistinct("to"), F.min("to"), F.max("to"), F.sum((F.col("to") == F.col("id")).cast("int")), F.sum((F.col("to") == F.col("other")).cast("int"))).first()
    assert tuple(got[:3]) == (n, 0, n - 1)
    if n >= 1009:
        assert got[3] < 20 and got[4] < 20
