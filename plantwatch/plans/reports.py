"""Report procedures: tables behind an executive report, work orders and a root-cause analysis."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.functions.rules import (
    ALERT_SCORE,
    ALERT_STATE,
    CRITICAL_STATE,
    NORMAL_STATE,
    OVERSTRAIN_LIMIT,
    MODES,
    folio,
    health_status,
    mode_signature,
)
from plantwatch.operators.episodes import (
    ABRUPT_ROWS,
    Spans,
    alerts_with_context,
    any_breach,
    best_epoch,
    breached_names,
    co_moving,
    first_breach,
    rise_kind,
    run_extremes,
    score_timeline,
    sensor_values,
    trend_slope,
    urgency,
)
from plantwatch.operators.filters import has_node, open_alerts
from plantwatch.operators.fleet import alerts as top_alerts
from plantwatch.operators.fleet import diagnostic, equipment_summary, top_risk
from plantwatch.operators.knowledge import attach_interventions, mode_label
from plantwatch.operators.ordered import ROWS_PER_SLICE, with_position
from plantwatch.session import cut_lineage

READING_ORDER = ("event_ts", "reading_id")


def _alerted(alert_rows: DataFrame) -> DataFrame:
    # Each node once, before the shuffle of the join.
    return open_alerts(alert_rows).select("node_id").distinct()


def nodes_without_alerts(nodes: DataFrame, alert_rows: DataFrame) -> DataFrame:
    """Nodes that have no open alert."""
    return nodes.join(_alerted(alert_rows), "node_id", "left_anti")


def nodes_with_open_alerts(nodes: DataFrame, alert_rows: DataFrame) -> DataFrame:
    return nodes.join(_alerted(alert_rows), "node_id", "left_semi")


def plant_status(diagnosed: DataFrame) -> DataFrame:
    """Worst state over all nodes, as one row."""
    rank = F.max(
        F.when(F.col("status") == CRITICAL_STATE, 2).when(F.col("status") == ALERT_STATE, 1).otherwise(0)
    )
    state = F.when(rank == 2, CRITICAL_STATE).when(rank == 1, ALERT_STATE).otherwise(NORMAL_STATE)
    return diagnosed.agg(state.alias("status"))


def executive_status(readings: DataFrame, alert_rows: DataFrame) -> DataFrame:
    return plant_status(diagnostic(has_node(readings), alert_rows))


def executive_attention(readings: DataFrame, alert_rows: DataFrame, nodes: int = 3) -> DataFrame:
    """The nodes at highest risk with state, failure mode in plain words and recent figures."""
    at_risk = top_risk(readings, limit=nodes).select(
        "node_id", "node_name", "equipment_id", "avg_score", "readings_in_alert", "pct_in_alert"
    )
    detail = diagnostic(has_node(readings), alert_rows).select(
        "node_id",
        "node_name",
        "equipment_id",
        "status",
        F.col("dominant_failure_mode").alias("failure_mode"),
        "recent_avg_score",
        "recent_failures",
        F.size("recent_alerts").alias("alert_groups"),
    )
    return mode_label(detail.join(at_risk, ["node_id", "node_name", "equipment_id"]))


def executive_critical(alert_rows: DataFrame, limit: int = 10) -> DataFrame:
    """Open critical alerts by score; no rows when there are none."""
    return mode_label(top_alerts(open_alerts(alert_rows, "critical"), limit=limit))


def executive_fallback(readings: DataFrame) -> DataFrame:
    """Figures per equipment, which stand in where no reading names a node."""
    return equipment_summary(readings).withColumn("status", health_status(F.col("avg_anomaly_score")))


def executive_report(
    readings: DataFrame, alert_rows: DataFrame, nodes: int = 3, open_limit: int = 10
) -> dict[str, DataFrame]:
    """All tables of the executive report."""
    return {
        "status": executive_status(readings, alert_rows),
        "attention": executive_attention(readings, alert_rows, nodes),
        "critical_alerts": executive_critical(alert_rows, open_limit),
        "fallback": executive_fallback(readings),
    }


def work_orders(
    readings: DataFrame,
    alert_rows: DataFrame,
    day: date,
    threshold: float = ALERT_SCORE,
    trend: int = 50,
    steps: bool = True,
) -> DataFrame:
    """Work orders of the nodes at risk, numbered by falling risk.

    A node is at risk when its average or its recent average reaches the threshold, or its trend
    calls for action. With `steps` there is one row per work step, else one row per order.
    """
    named = has_node(readings)
    diagnosed = diagnostic(named, alert_rows)
    slopes = trend_slope(named, ["node_id"], READING_ORDER, n=trend).drop("n")
    breaches = (
        named.select("node_id", F.explode(breached_names()).alias("_v"))
        .groupBy("node_id")
        .agg(F.array_join(F.array_sort(F.collect_set("_v")), ", ").alias("breached"))
    )
    window = urgency(F.col("slope"), F.col("status"))
    orders = (
        diagnosed.join(slopes, "node_id")
        .join(breaches, "node_id", "left")
        .withColumn("urgency", window)
        .filter(
            (F.col("avg_score") >= threshold)
            | (F.col("recent_avg_score") >= threshold)
            | (F.col("urgency") != "planned")
        )
    )
    # Numbers run over all orders of the day, by position and not in one window.
    by_risk = ["_risk", "node_id", "node_name", "equipment_id"]
    numbered = with_position(orders.withColumn("_risk", -F.col("avg_score")), [], by_risk, "_place", checkpoint=True)
    issued = F.lit(day).cast("date")
    priority = (
        F.when(F.col("urgency") == "hours", "high").when(F.col("urgency") == "days", "medium").otherwise("low")
    )
    issued_orders = numbered.select(
        folio(issued, F.col("_place") + 1).alias("folio"),
        issued.alias("issued"),
        "node_id",
        "node_name",
        "equipment_id",
        "status",
        "dominant_failure_mode",
        *[f"avg_prob_{m.lower()}" for m in MODES],
        "avg_score",
        "first_score",
        "last_score",
        "slope",
        F.coalesce("breached", F.lit("")).alias("breached"),
        "urgency",
        priority.alias("priority"),
    )
    return attach_interventions(issued_orders) if steps else issued_orders


def cause_timeline(
    context: DataFrame | Spans, abrupt_rows: int = ABRUPT_ROWS, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """How the score developed around each alert, and whether the rise was abrupt."""
    timeline = score_timeline(
        context, ["alert_id"], READING_ORDER, rows_per_slice=rows_per_slice, checkpoint=True
    )
    return rise_kind(timeline, abrupt_rows)


def cause_trigger(context: DataFrame) -> DataFrame:
    """(alert_id, trigger): the variable that left its range first.

    What happened up to the alert decides; the readings after it may already be consequences.
    """
    breach = first_breach(context.filter(F.col("phase") != "after"), ["alert_id"], READING_ORDER)
    return breach.select("alert_id", F.col("variable").alias("trigger"))


def cause_deviations(alert_rows: DataFrame, context: DataFrame) -> DataFrame:
    """Per alert and sensor the value at the alert, the normal range, the deviation, and whether it
    was the first to leave its range."""
    first = cause_trigger(context).withColumnRenamed("trigger", "_trigger")
    return (
        sensor_values(alert_rows, ["alert_id"])
        .join(first, "alert_id", "left")
        .withColumn("trigger", F.coalesce(F.col("variable") == F.col("_trigger"), F.lit(False)))
        .select("alert_id", "ordinal", "variable", "value", "low", "high", "deviation_pct", "trigger")
    )


def cause_verdict(alert_rows: DataFrame, context: DataFrame, osf_limit: float = OVERSTRAIN_LIMIT) -> DataFrame:
    """The modes whose signature the sensors show at the alert, against the reported mode."""
    signs = mode_signature(osf_limit)
    shown = F.array_compact(F.array(*[F.when(signs[m.lower()], F.lit(m)) for m in MODES if m != "RNF"]))
    quiet = ~any_breach() & F.col("trigger").isNull()
    verdict = (
        F.when(F.array_contains("shown_modes", F.col("failure_mode")), "signature confirmed")
        .when(F.size("shown_modes") > 0, "other mode")
        .when(quiet, "no sensor out of range: sensor noise")
        .otherwise("out of range without a signature")
    )
    return (
        alert_rows.withColumn("shown_modes", shown)
        .join(cause_trigger(context), "alert_id", "left")
        .withColumn("verdict", verdict)
        .select("alert_id", "node_id", "failure_mode", "severity", "shown_modes", "trigger", "verdict")
    )


def root_cause(
    alert_rows: DataFrame,
    readings: DataFrame,
    before_s: int = 3600,
    after_s: int = 900,
    osf_limit: float = OVERSTRAIN_LIMIT,
    abrupt_rows: int = ABRUPT_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> dict[str, DataFrame]:
    """All tables of the root-cause analysis, for all given alerts at once. `together` lists the sets
    of variables out of range in the same reading."""
    # Four tables use it; the range join runs once.
    context = cut_lineage(alerts_with_context(alert_rows, readings, before_s, after_s))
    return {
        "timeline": cause_timeline(context, abrupt_rows, rows_per_slice),
        "deviations": cause_deviations(alert_rows, context),
        "together": co_moving(context, ["alert_id"]),
        "verdict": cause_verdict(alert_rows, context, osf_limit),
    }


def training_report(
    log: DataFrame, metric: str = "f1_macro", patience: int = 12, run: str = "run_id", epoch: str = "epoch"
) -> DataFrame:
    """One row per run: best epoch and metric, stop epoch, and the extremes of its losses."""
    best = best_epoch(log, metric, patience, run, epoch)
    if {"loss", "eval_loss", "grad_norm"} <= set(log.columns):
        return best.join(run_extremes(log, run, epoch), run)
    return best
