"""Pixel statistics, labels and chat rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwatch.operators import scenes

NAN = float("nan")
SCHEMA = "category string, stem string, celsius array<double>, r array<double>, g array<double>, b array<double>"


def scene(spark, celsius, r=None, g=None, b=None, category="Fire"):
    gray = [100.0, 180.0] * (len(celsius) // 2 + 1)
    r = r or gray[: len(celsius)]
    return spark.createDataFrame([(category, "00001", celsius, r, g or r, b or r)], SCHEMA)


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize(
    "celsius, expected",
    [
        ([20.0] * 100, (False, "none", "none")),
        ([60.0] * 100, (False, "none", "none")),
        ([80.0] * 100, (True, "low", "none")),
        ([150.0] + [20.0] * 99, (True, "low", "small")),
        ([401.0] * 5 + [20.0] * 95, (True, "high", "medium")),
        ([300.0] * 6 + [20.0] * 94, (True, "medium", "large")),
        ([NAN, 300.0] + [20.0] * 98, (True, "medium", "medium")),
        ([NAN] * 4, (None, None, None)),
    ],
)
def test_heat(spark, large, celsius, expected):
    got = scenes.build_labels(scene(spark, celsius), large_pictures=large).first()
    assert (got.fire_present, got.thermal_hotspot_intensity, got.fire_size) == expected


@pytest.mark.parametrize("large", [False, True])
def test_smoke_needs_fire(spark, large):
    hazy = [200.0] * 6 + [10.0] * 94
    hot, cold = [300.0] + [20.0] * 99, [20.0] * 100
    assert scenes.build_labels(scene(spark, hot, hazy), large).first().smoke_visible is True
    assert scenes.build_labels(scene(spark, cold, hazy), large).first().smoke_visible is False
    five = [200.0] * 5 + [10.0] * 95
    assert scenes.build_labels(scene(spark, hot, five), large).first().smoke_visible is False
    vivid = scenes.build_labels(scene(spark, hot, hazy, g=[100.0] * 100), large).first()
    assert vivid.smoke_visible is False


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("pixels, limited", [([29.0, 29.0], True), ([221.0] * 2, True), ([100.0, 129.0], True), ([100.0, 131.0], False)])
def test_quality(spark, large, pixels, limited):
    got = scenes.build_labels(scene(spark, [20.0, 20.0], pixels), large).first()
    assert got.image_quality_limited is limited


def test_both_engines_agree(spark):
    rng = np.random.default_rng(1)
    rows = [
        ("Fire", str(i), *(rng.uniform(lo, hi, 50).tolist() for lo, hi in ((0, 300), (0, 255), (0, 255), (0, 255))))
        for i in range(20)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    columns = ["stem", *[F.round(c, 9).alias(c) for c in ("max_c", "pct_hot", "smoke_share", "gray_mean", "gray_std")]]
    plain = scenes.build_labels(df).select(*columns, *scenes.LABEL_FIELDS)
    assert plain.exceptAll(scenes.build_labels(df, True).select(*columns, *scenes.LABEL_FIELDS)).count() == 0


def test_mismatch(spark):
    warm = scene(spark, [80.0] * 4, category="No Fire")
    assert scenes.label_mismatch(scenes.build_labels(warm)).count() == 1
    assert scenes.label_mismatch(scenes.build_labels(scene(spark, [80.0] * 4))).count() == 0


def test_chat_rows(spark):
    rows = scenes.label_rows(scenes.build_labels(scene(spark, [300.0] * 4))).withColumn("split", F.lit("train"))
    got = scenes.build_chat_rows(rows, " system \n", "question").first()
    roles = [m.role for m in got.messages]
    assert roles == ["system", "user", "assistant"] and got.split == "train"
    assert got.messages[0].content[0].text == "system"
    user = [(c.type, c.image, c.text) for c in got.messages[1].content]
    assert user == [
        ("image", "fire_00001_rgb.jpg", None),
        ("image", "fire_00001_thermal.jpg", None),
        ("text", None, "question"),
    ]
    answer = got.messages[2].content[0].text
    label = json.loads(answer)
    assert list(label) == list(scenes.LABEL_FIELDS) and answer == json.dumps(label)
    assert label["fire_size"] == "large"
