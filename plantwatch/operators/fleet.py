"""The nine analytics calls over readings, alerts and process readings.

A call that names no node answers for all nodes in one job. Ties are broken by key columns, so a
limited answer is always the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantwatch.functions.numbers import report_round
from plantwatch.functions.rules import (
    ALERT_SCORE,
    MODES,
    NO_DATA_STATE,
    PROBABILITIES,
    SENSORS,
    health_status,
    leading_mode,
)
from plantwatch.local import local_table
from plantwatch.operators.filters import (
    alert_columns,
    anomalies_only,
    has_node,
    optional_equals,
    process_columns,
    reading_columns,
    trend_columns,
)
from plantwatch.operators.ordered import last_n, top_per_key

NODE = ("node_id", "node_name", "equipment_id")


def checked_limit(limit: int) -> int:
    """Row limit of a call, as asked for."""
    if limit < 0:
        raise ValueError(f"limit must not be negative: {limit}")
    return limit


def newest_first(df: DataFrame, *ties: str) -> list[Column]:
    """Order by time and reading number, newest first. Numbers restart when a gateway does, so time leads."""
    return [F.desc(c) for c in ("event_ts", "reading_id") if c in df.columns] + [F.col(c) for c in ties if c in df.columns]


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """First k rows; `order` must end in columns that identify a row."""
    return df.orderBy(*order).limit(k)


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """First k rows per key with their `rank`."""
    return top_per_key(df, keys, order, k)


def rank_values(df: DataFrame, value: str, name: str) -> DataFrame:
    """Rows by falling value, ties by name."""
    return df.orderBy(F.desc(value), name)


def _rounded_avg(column: str, digits: int, name: str) -> Column:
    return report_round(F.avg(column), digits).alias(name)


def _rounded_max(column: str, digits: int, name: str) -> Column:
    return report_round(F.max(column), digits).alias(name)


def _failures(name: str = "total_failures") -> Column:
    return F.sum(F.col("predicted_failure").cast("long")).alias(name)


def _readings(name: str = "total_readings") -> Column:
    return F.count(F.lit(1)).alias(name)


def sensor_readings(
    df: DataFrame, equipment_id: str | None = None, node_id: str | None = None, limit: int = 20
) -> DataFrame:
    """Newest readings."""
    wanted = optional_equals(df, equipment_id=equipment_id, node_id=node_id)
    return reading_columns(top_k(wanted, newest_first(df, "equipment_id", "node_id", "node_name"), checked_limit(limit)))


def alerts(
    df: DataFrame, severity: str | None = None, node_id: str | None = None, limit: int = 20
) -> DataFrame:
    """Alerts with the highest scores; equal scores newest first."""
    wanted = optional_equals(df, severity=severity, node_id=node_id)
    ties = [F.desc(c) for c in ("event_ts", "alert_id", "equipment_id", "node_id", "failure_mode") if c in df.columns]
    return alert_columns(top_k(wanted, [F.desc("anomaly_score"), *ties], checked_limit(limit)))


def list_nodes(df: DataFrame) -> DataFrame:
    return (
        has_node(df)
        .groupBy(*NODE)
        .agg(
            _readings(),
            _rounded_avg("anomaly_score", 4, "avg_anomaly_score"),
            _failures(),
            _rounded_max("anomaly_score", 4, "max_anomaly_score"),
        )
        .orderBy(F.desc("avg_anomaly_score"), *NODE)
    )


def equipment_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("equipment_id").agg(
        _readings(),
        _rounded_avg("anomaly_score", 4, "avg_anomaly_score"),
        _failures(),
        *[_rounded_avg(p, 4, f"avg_{p}") for p in PROBABILITIES],
    )


def node_trend(df: DataFrame, node_id: str, limit: int = 50) -> DataFrame:
    """The last readings of one node, oldest first."""
    if not node_id:
        raise ValueError("node_id is required")
    wanted = optional_equals(df, node_id=node_id)
    ties = ("equipment_id", "node_name")
    newest = top_k(wanted, newest_first(df, *ties), checked_limit(limit))
    oldest = [F.col(c) for c in ("event_ts", "reading_id") if c in df.columns] + [F.desc(c) for c in ties if c in df.columns]
    return trend_columns(newest.orderBy(*oldest))


def top_risk(df: DataFrame, limit: int = 5, threshold: float = ALERT_SCORE) -> DataFrame:
    """Nodes with the highest average score and their share of readings in alert."""
    in_alert = F.sum(F.when(F.col("anomaly_score") >= threshold, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    by_node = (
        has_node(df)
        .groupBy(*NODE)
        .agg(
            _readings(),
            _rounded_avg("anomaly_score", 4, "avg_score"),
            _rounded_max("anomaly_score", 4, "max_score"),
            _failures(),
            in_alert.alias("readings_in_alert"),
        )
        .withColumn(
            "pct_in_alert", report_round(F.col("readings_in_alert") * 100.0 / F.col("total_readings"), 1)
        )
    )
    return top_k(by_node, [F.desc("avg_score"), *NODE], checked_limit(limit))


def failure_heatmap(df: DataFrame) -> DataFrame:
    """Average probability per mode and node name; the leading mode is that of the exact averages."""
    averages = has_node(df).groupBy("node_name").agg(
        *[F.avg(p).alias(p) for p in PROBABILITIES],
        _rounded_avg("anomaly_score", 4, "avg_anomaly_score"),
    )
    leading = leading_mode({m: F.col(p) for m, p in zip(MODES, PROBABILITIES)})
    return averages.select(
        "node_name",
        *[report_round(F.col(p), 4).alias(p) for p in PROBABILITIES],
        "avg_anomaly_score",
        leading.alias("dominant_failure_mode"),
    ).orderBy(F.desc("avg_anomaly_score"), "node_name")


def node_stats(df: DataFrame) -> DataFrame:
    sensor_digits = dict(zip(SENSORS, (2, 2, 0, 2, 1)))
    return df.groupBy(*NODE).agg(
        _readings(),
        _rounded_avg("anomaly_score", 4, "avg_score"),
        _rounded_max("anomaly_score", 4, "max_score"),
        _failures(),
        *[_rounded_avg(p, 4, f"avg_{p}") for p in PROBABILITIES],
        *[_rounded_avg(s, d, f"avg_{s}") for s, d in sensor_digits.items()],
    )


def recent_stats(
    df: DataFrame, by: str = "node_id", n: int = 20, order: Sequence[str] = ("event_ts", "reading_id")
) -> DataFrame:
    """Average score and failures over the last n readings of every `by` value."""
    recent = last_n(df.select(by, "anomaly_score", "predicted_failure", *order), [by], list(order), n)
    return recent.groupBy(by).agg(
        _rounded_avg("anomaly_score", 4, "recent_avg_score"), _failures("recent_failures")
    )


def alert_breakdown(df: DataFrame, by: str = "node_id", top: int = 10) -> DataFrame:
    """Alerts per failure mode and severity, the `top` groups with the highest score per `by`."""
    groups = df.groupBy(by, "failure_mode", "severity").agg(
        F.count(F.lit(1)).alias("count"), _rounded_max("anomaly_score", 4, "max_score")
    )
    return top_k_per_key(groups, [by], [F.desc("max_score"), "failure_mode", "severity"], top)


def diagnostic(
    readings: DataFrame,
    alert_rows: DataFrame,
    by: str = "node_id",
    values: Sequence[str] | None = None,
    recent: int = 20,
) -> DataFrame:
    """Full diagnostic, one row per node group.

    `by` is "node_id" or "equipment_id" and selects what the recent readings and alerts are counted
    over. With `values` only those are diagnosed, and a value without readings gets a row that says
    so. `recent_alerts` is an array of at most ten (mode, severity) groups.
    """
    if by not in ("node_id", "equipment_id"):
        raise ValueError("diagnose by node_id or equipment_id")
    if values is not None:
        readings = readings.filter(F.col(by).isin(list(values)))
        alert_rows = alert_rows.filter(F.col(by).isin(list(values)))
    readings = readings.filter(F.col(by) != "")
    stats = node_stats(readings)
    breakdown = (
        alert_breakdown(alert_rows, by)
        .groupBy(by)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "failure_mode", "severity", "count", "max_score"))),
                lambda a: a.dropFields("rank"),
            ).alias("recent_alerts")
        )
    )
    joined = stats.join(recent_stats(readings, by, recent), by, "left").join(breakdown, by, "left")
    if values is not None:
        asked = local_table(readings.sparkSession, [(v,) for v in values], f"{by} string")
        joined = asked.join(joined, by, "left")
    averages = {m: F.col(f"avg_{p}") for m, p in zip(MODES, PROBABILITIES)}
    return joined.select(
        *NODE,
        F.coalesce(health_status(F.col("avg_score")), F.lit(NO_DATA_STATE)).alias("status"),
        F.coalesce(leading_mode(averages), F.lit("N/A")).alias("dominant_failure_mode"),
        *[c for c in stats.columns if c not in NODE],
        "recent_avg_score",
        "recent_failures",
        F.coalesce("recent_alerts", F.array().cast(breakdown.schema["recent_alerts"].dataType)).alias(
            "recent_alerts"
        ),
    )


def process_readings(
    df: DataFrame,
    equipment_id: str | None = None,
    tag: str | None = None,
    regime: str | None = None,
    anomaly_only: bool = False,
    limit: int = 20,
) -> DataFrame:
    """Newest process readings; the ISO text of the time sorts like the time."""
    wanted = optional_equals(df, equipment_id=equipment_id, tag=tag, regime=regime)
    if anomaly_only:
        wanted = anomalies_only(wanted)
    newest = [F.desc("timestamp"), "equipment_id", "tag", "regime", "reading_id", "value"]
    present = [c for c in newest if not isinstance(c, str) or c in df.columns]
    return process_columns(top_k(wanted, present, checked_limit(limit)))
