"""Scoring rules as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantwatch.functions.numbers import known, report_round

# Failure modes in their order of precedence.
MODES = ("TWF", "HDF", "PWF", "OSF", "RNF")
PROBABILITIES = tuple(f"prob_{mode.lower()}" for mode in MODES)
MULTIPLE = "MULTIPLE"

# Score thresholds.
ALERT_SCORE = 0.65
HIGH_SCORE = 0.80
CRITICAL_SCORE = 0.90
FAILURE_PROBABILITY = 0.5
POSSIBLE_PROBABILITY = 0.25

# Health states.
CRITICAL_STATE = "CRÍTICO"
ALERT_STATE = "ALERTA"
NORMAL_STATE = "NORMAL"
NO_DATA_STATE = "SIN DATOS"

# Product grades and their codes.
PRODUCT_CODES = {"L": 0, "M": 1, "H": 2}

# Sensors in feature order with the limits of normal operation.
SENSOR_RANGES = {
    "air_temp_k": (295.0, 304.0),
    "process_temp_k": (305.0, 313.0),
    "rpm": (1168.0, 2886.0),
    "torque_nm": (3.8, 76.6),
    "tool_wear_min": (0.0, 253.0),
}
SENSORS = tuple(SENSOR_RANGES)

# Limits in the failure signatures.
WORN_TOOL_MIN = 200
STRAINED_TORQUE_NM = 60
SMALL_DELTA_K = 8.6
SLOW_RPM = 1380
POWER_RANGE_W = (3500.0, 9000.0)
OVERSTRAIN_LIMIT = 11000.0


def _banded(value: Column, bands: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first (lower bound, label) that `value` reaches."""
    label = F.when(value.isNull(), None)
    for bound, name in bands:
        label = label.when(value >= bound, name)
    return label.otherwise(otherwise)


def _capped(value: Column, bands: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first (upper bound, label) that `value` does not exceed."""
    label = F.when(value.isNull(), None)
    for bound, name in bands:
        label = label.when(value <= bound, name)
    return label.otherwise(otherwise)


def severity(score: Column) -> Column:
    return _banded(
        known(score), [(CRITICAL_SCORE, "critical"), (HIGH_SCORE, "high"), (ALERT_SCORE, "medium")], "low"
    )


def health_status(average_score: Column) -> Column:
    return _banded(known(average_score), [(HIGH_SCORE, CRITICAL_STATE), (ALERT_SCORE, ALERT_STATE)], NORMAL_STATE)


def _first_equal(values: Mapping[str, Column], target: Column) -> Column:
    chain = F.when(target.isNull(), None)
    for name, value in values.items():
        chain = chain.when(value == target, name)
    return chain


def leading_mode(probabilities: Mapping[str, Column]) -> Column:
    """Mode with the largest value; the earliest mode wins a tie, NULLs are skipped."""
    return _first_equal(probabilities, F.greatest(*probabilities.values()))


def dominant_mode(probabilities: Mapping[str, Column]) -> tuple[Column, Column]:
    """(mode, probability) of an alert; without a positive probability the mode is MULTIPLE."""
    values = {mode: known(value) for mode, value in probabilities.items()}
    top = F.greatest(*values.values())
    mode = F.when(top <= 0, F.lit(MULTIPLE)).otherwise(_first_equal(values, top))
    return mode, F.greatest(top, F.when(top.isNotNull(), F.lit(0.0)))


def mode_probabilities() -> dict[str, Column]:
    return {mode: F.col(name) for mode, name in zip(MODES, PROBABILITIES)}


def anomaly_score(probabilities: Sequence[Column]) -> Column:
    return F.greatest(*probabilities)


def predicted_failure(score: Column, threshold: float = FAILURE_PROBABILITY) -> Column:
    return (score >= threshold).cast("int")


def probability_band(probability: Column) -> Column:
    return (
        F.when(probability.isNull(), None)
        .when(probability > FAILURE_PROBABILITY, "alert")
        .when(probability > POSSIBLE_PROBABILITY, "possible")
        .otherwise("normal")
    )


def any_possible(probabilities: Sequence[Column]) -> Column:
    return F.exists(F.array(*probabilities), lambda p: p > POSSIBLE_PROBABILITY)


def delta_t() -> Column:
    return F.col("process_temp_k") - F.col("air_temp_k")


def power_w() -> Column:
    return F.col("torque_nm") * F.col("rpm") * F.lit(2 * pi) / F.lit(60.0)


def strain() -> Column:
    return F.col("tool_wear_min") * F.col("torque_nm")


def mode_signature(osf_limit: float | Mapping[str, float] = OVERSTRAIN_LIMIT) -> dict[str, Column]:
    """One boolean per mode telling whether the sensors of a row show its signature.

    `osf_limit` is one strain limit, or one per product grade. `twf_strong` is the tool-wear
    signature together with raised torque.
    """
    if isinstance(osf_limit, Mapping):
        limit = F.coalesce(
            *[F.when(F.col("product_type") == grade, F.lit(float(v))) for grade, v in osf_limit.items()],
            F.lit(OVERSTRAIN_LIMIT),
        )
    else:
        limit = F.lit(float(osf_limit))
    low_power, high_power = POWER_RANGE_W
    # The difference of two one-decimal readings must not carry binary noise across the limit.
    twf = F.col("tool_wear_min") > WORN_TOOL_MIN
    signature = {
        "twf": twf,
        "twf_strong": twf & (F.col("torque_nm") > STRAINED_TORQUE_NM),
        "hdf": (F.round(delta_t(), 6) < SMALL_DELTA_K) & (F.col("rpm") < SLOW_RPM),
        "pwf": ~power_w().between(low_power, high_power),
        "osf": strain() > limit,
    }
    signature["rnf"] = ~(signature["twf"] | signature["hdf"] | signature["pwf"] | signature["osf"])
    return signature


def range_deviation(value: Column, low: Column, high: Column) -> Column:
    """Signed percentage past the breached limit, 0 inside the range; NULL for a value that is no number."""
    value = known(value)
    past_low = F.try_divide((value - low) * 100.0, F.abs(low))
    past_high = F.try_divide((value - high) * 100.0, F.abs(high))
    return (
        F.when(value.isNull(), None).when(value < low, past_low).when(value > high, past_high).otherwise(0.0)
    )


def deviation_pct(value: Column, nominal: Column) -> Column:
    """Percentage away from the nominal value, two digits; 0 where the nominal value is 0."""
    return F.when(nominal == 0, F.lit(0.0)).otherwise(
        report_round(F.try_divide(value - nominal, F.abs(nominal)) * 100.0, 2)
    )


def hotspot_intensity(max_celsius: Column) -> Column:
    return _capped(max_celsius, [(60.0, "none"), (200.0, "low"), (400.0, "medium")], "high")


def fire_size(pct_hot: Column) -> Column:
    return (
        F.when(pct_hot.isNull(), None)
        .when(pct_hot == 0, "none")
        .when(pct_hot <= 1, "small")
        .when(pct_hot <= 5, "medium")
        .otherwise("large")
    )


def scene_id(category: Column, stem: Column) -> Column:
    return F.concat_ws("_", F.lower(F.replace(category, F.lit(" "), F.lit("_"))), stem)


def image_name(scene: Column, kind: str) -> Column:
    """File name of the "rgb" or "thermal" picture of a scene."""
    return F.concat(scene, F.lit(f"_{kind}.jpg"))


def scene_of_image(name: Column, kind: str = "rgb") -> Column:
    return F.regexp_replace(name, rf"_{kind}\.jpg$", "")


def folio(day: Column, number: Column) -> Column:
    """Work order number OT-YYYYMMDD-XXX."""
    digits = number.cast("string")
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    return F.concat(F.lit("OT-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), padded)


def encode_product_type(product_type: Column) -> Column:
    code = F.lit(None).cast("int")
    for name, number in reversed(PRODUCT_CODES.items()):
        code = F.when(product_type == name, F.lit(number)).otherwise(code)
    return code


def signal_tag(auc: Column) -> Column:
    """How much a score tells about its label; unknown counts as nothing."""
    return F.when(auc > 0.85, "good").when(auc > 0.5, "weak").otherwise("none")
