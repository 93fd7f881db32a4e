"""Filters and fixed projections over readings, alerts and process readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantwatch.functions.numbers import report_round
from plantwatch.functions.rules import PROBABILITIES, SENSORS, encode_product_type

READING_COLUMNS = (
    "reading_id", "equipment_id", "node_id", "node_name", *SENSORS,
    "anomaly_score", "predicted_failure", *PROBABILITIES,
)
ALERT_COLUMNS = (
    "equipment_id", "node_id", "node_name", "failure_mode", "probability", "severity",
    "anomaly_score", *SENSORS, "resolved",
)


def optional_equals(df: DataFrame, **filters: object) -> DataFrame:
    """AND of equality filters; an empty or missing value is no filter."""
    for column, wanted in filters.items():
        if wanted is not None and wanted != "":
            df = df.filter(F.col(column) == F.lit(wanted))
    return df


def has_node(df: DataFrame) -> DataFrame:
    """Rows that name a node; NULL fails the comparison as well."""
    return df.filter(F.col("node_id") != "")


def anomalies_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_anomaly") == 1)


def deviation_over(df: DataFrame, pct: float = 15.0) -> DataFrame:
    return df.filter(F.abs("deviation_pct") > pct)


def normal_only(df: DataFrame, target: str = "machine_failure") -> DataFrame:
    return df.filter(F.col(target) == 0)


def open_alerts(df: DataFrame, severity: str | None = None) -> DataFrame:
    return optional_equals(df.filter(F.col("resolved") == 0), severity=severity)


def reading_columns(df: DataFrame) -> DataFrame:
    return df.select(*READING_COLUMNS)


def alert_columns(df: DataFrame) -> DataFrame:
    return df.select(*ALERT_COLUMNS)


def trend_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "reading_id",
        "node_name",
        report_round(F.col("anomaly_score"), 4).alias("anomaly_score"),
        "predicted_failure",
        report_round(F.col("air_temp_k"), 2).alias("air_temp_k"),
        report_round(F.col("process_temp_k"), 2).alias("process_temp_k"),
        "rpm",
        report_round(F.col("torque_nm"), 2).alias("torque_nm"),
        "tool_wear_min",
    )


def process_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "equipment_id", "tag", "variable", "variable_medicion",
        report_round(F.col("value"), 3).alias("value"),
        "unit", "regime",
        report_round(F.col("nominal_value"), 3).alias("nominal_value"),
        report_round(F.col("deviation_pct"), 2).alias("deviation_pct"),
        "is_anomaly", "desde", "hasta", "timestamp",
    )


def feature_names(include_type: bool = True) -> list[str]:
    return [*SENSORS, "type_code"] if include_type else list(SENSORS)


def feature_columns(include_type: bool = True) -> list[Column]:
    """The five sensors and the encoded product grade as doubles, in their fixed order."""
    columns = [F.col(name).cast("double").alias(name) for name in SENSORS]
    if include_type:
        columns.append(encode_product_type(F.col("product_type")).cast("double").alias("type_code"))
    return columns


def feature_vector(df: DataFrame, include_type: bool = True, name: str = "features") -> DataFrame:
    return df.withColumn(name, F.array(*feature_columns(include_type)))
