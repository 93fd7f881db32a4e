"""Boundary values of the rules."""

import math

import pytest
from pyspark.sql import functions as F

from plantwatch.functions import rules
from plantwatch.functions.numbers import report_round

NAN = float("nan")
PROBS = ", ".join(f"{p} double" for p in rules.PROBABILITIES)


@pytest.mark.parametrize(
    "score, severity, status",
    [
        (0.6499, "low", "NORMAL"),
        (0.65, "medium", "ALERTA"),
        (0.7999, "medium", "ALERTA"),
        (0.80, "high", "CRÍTICO"),
        (0.8999, "high", "CRÍTICO"),
        (0.90, "critical", "CRÍTICO"),
        (None, None, None),
    ],
)
def test_severity_and_status(one, score, severity, status):
    got = one({"s": score}, "s double", rules.severity(F.col("s")), rules.health_status(F.col("s")))
    assert got == (severity, status)


@pytest.mark.parametrize(
    "probs, mode, probability",
    [
        ((0.3, 0.3, 0.1, 0.3, 0.0), "TWF", 0.3),
        ((0.1, 0.4, 0.4, 0.4, 0.4), "HDF", 0.4),
        ((0.1, 0.2, 0.5, 0.5, 0.5), "PWF", 0.5),
        ((0.1, 0.2, 0.3, 0.6, 0.6), "OSF", 0.6),
        ((0.1, 0.2, 0.3, 0.4, 0.6), "RNF", 0.6),
        ((0.0, 0.0, 0.0, 0.0, 0.0), "MULTIPLE", 0.0),
        ((None, 0.2, None, 0.1, None), "HDF", 0.2),
        ((NAN, 0.2, 0.1, 0.1, 0.1), "HDF", 0.2),
        ((None, None, None, None, None), None, None),
    ],
)
def test_dominant_mode(one, probs, mode, probability):
    values = dict(zip(rules.PROBABILITIES, probs))
    assert one(values, PROBS, *rules.dominant_mode(rules.mode_probabilities())) == (mode, probability)


def test_leading_mode_takes_the_first_of_equals(one):
    values = dict(zip(rules.PROBABILITIES, (0.1, 0.4, None, 0.4, 0.0)))
    assert one(values, PROBS, rules.leading_mode(rules.mode_probabilities())) == "HDF"


@pytest.mark.parametrize(
    "celsius, intensity", [(60.0, "none"), (60.01, "low"), (200.0, "low"), (400.0, "medium"), (400.01, "high")]
)
def test_intensity(one, celsius, intensity):
    assert one({"c": celsius}, "c double", rules.hotspot_intensity(F.col("c"))) == intensity


@pytest.mark.parametrize(
    "pct, size", [(0.0, "none"), (0.01, "small"), (1.0, "small"), (5.0, "medium"), (5.01, "large")]
)
def test_size(one, pct, size):
    assert one({"p": pct}, "p double", rules.fire_size(F.col("p"))) == size


@pytest.mark.parametrize(
    "value, nominal, expected",
    [(5.0, 0.0, 0.0), (115.0, 100.0, 15.0), (85.0, 100.0, -15.0), (-8.0, -10.0, 20.0), (None, 1.0, None)],
)
def test_deviation_pct(one, value, nominal, expected):
    got = one({"v": value, "n": nominal}, "v double, n double", rules.deviation_pct(F.col("v"), F.col("n")))
    assert got == expected


@pytest.mark.parametrize("value, expected", [(4.0, 0.0), (3.8, 0.0), (1.9, -50.0), (153.2, 100.0), (None, None)])
def test_range_deviation(one, value, expected):
    got = one({"v": value}, "v double", rules.range_deviation(F.col("v"), F.lit(3.8), F.lit(76.6)))
    assert got is expected if expected is None else math.isclose(got, expected, abs_tol=1e-9)


SIGNATURE_SCHEMA = "air_temp_k double, process_temp_k double, rpm int, torque_nm double, tool_wear_min int, product_type string"


@pytest.mark.parametrize(
    "row, modes",
    [
        ((300.2, 310.3, 1562, 41.2, 64, "M"), {"rnf"}),
        ((303.3, 307.5, 1270, 49.0, 99, "M"), {"hdf"}),
        ((300.3, 310.3, 1558, 41.5, 215, "M"), {"twf"}),
        ((301.9, 311.8, 1305, 64.5, 175, "M"), {"osf"}),
        ((300.0, 308.6, 1300, 45.0, 10, "M"), {"rnf"}),
        ((300.0, 308.5, 1380, 45.0, 10, "M"), {"rnf"}),
        ((300.0, 310.0, 2800, 60.5, 210, "M"), {"twf", "twf_strong", "pwf", "osf"}),
    ],
)
def test_signature(one, row, modes):
    signs = rules.mode_signature(11000)
    names = SIGNATURE_SCHEMA.replace(",", "").split()[::2]
    got = one(dict(zip(names, row)), SIGNATURE_SCHEMA, *signs.values())
    assert {name for name, hit in zip(signs, got) if hit} == modes


def test_signature_limit_per_grade(one):
    names = SIGNATURE_SCHEMA.replace(",", "").split()[::2]
    row = dict(zip(names, (300.0, 310.0, 1500, 60.0, 190, "H")))
    assert one(row, SIGNATURE_SCHEMA, rules.mode_signature({"L": 11000, "H": 13000})["osf"]) is False
    row["product_type"] = "L"
    assert one(row, SIGNATURE_SCHEMA, rules.mode_signature({"L": 11000, "H": 13000})["osf"]) is True


def test_band(one):
    for p, band in [(0.5, "possible"), (0.51, "alert"), (0.25, "normal"), (0.26, "possible"), (None, None)]:
        assert one({"p": p}, "p double", rules.probability_band(F.col("p"))) == band


def test_names(one):
    row = {"c": "No Fire", "s": "DJI_00012"}
    scene = rules.scene_id(F.col("c"), F.col("s"))
    assert one(row, "c string, s string", scene) == "no_fire_DJI_00012"
    name = rules.image_name(scene, "rgb")
    assert one(row, "c string, s string", name, rules.scene_of_image(name)) == (
        "no_fire_DJI_00012_rgb.jpg",
        "no_fire_DJI_00012",
    )


def test_folio(one):
    day = F.to_date("d")
    assert one({"d": "2024-03-07", "n": 7}, "d string, n int", rules.folio(day, F.col("n"))) == "OT-20240307-007"
    assert one({"d": "2024-03-07", "n": 1234}, "d string, n int", rules.folio(day, F.col("n"))) == "OT-20240307-1234"


def test_product_codes(one):
    for grade, code in [("L", 0), ("M", 1), ("H", 2), ("X", None), (None, None)]:
        assert one({"t": grade}, "t string", rules.encode_product_type(F.col("t"))) == code


def test_signal_tag(one):
    for auc, tag in [(0.86, "good"), (0.85, "weak"), (0.5, "none"), (None, "none")]:
        assert one({"a": auc}, "a double", rules.signal_tag(F.col("a"))) == tag


def test_report_round(one):
    for value, digits, expected in [(0.61725, 4, 0.6173), (1.005, 2, 1.01), (-0.5, 0, -1.0), (1e300, 2, 1e300)]:
        assert one({"v": value}, "v double", report_round(F.col("v"), digits)) == expected
    assert math.isnan(one({"v": NAN}, "v double", report_round(F.col("v"), 2)))
