"""Reading a series around an event: breaches, rises, trends; and training logs as series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.functions.numbers import known
from plantwatch.functions.rules import (
    ALERT_SCORE,
    ALERT_STATE,
    CRITICAL_STATE,
    SENSOR_RANGES,
    SENSORS,
    range_deviation,
)
from plantwatch.local import local_table
from plantwatch.operators.ordered import (
    CARRY,
    ROWS_PER_SLICE,
    SLICE,
    last_n,
    running,
    slice_rows,
    stored,
    top_per_key,
    with_past_rows,
)
from plantwatch.session import cut_lineage

# Rise of the score per reading that calls for action within days, or within hours.
SLOW_RISE = 0.0005
STEEP_RISE = 0.005
# Time buckets per span in the join of readings and alerts: more of them, more copies of an alert and fewer pairs beyond its span.
BUCKETS = 4
# Readings from the low point to the threshold that still count as a jump.
ABRUPT_ROWS = 3


def range_table(spark, ranges: Mapping[str, tuple[float, float]] = SENSOR_RANGES) -> DataFrame:
    rows = [(i, name, float(lo), float(hi)) for i, (name, (lo, hi)) in enumerate(ranges.items())]
    return local_table(spark, rows, "ordinal int, variable string, low double, high double")


def sensor_values(
    readings: DataFrame, keep: Sequence[str], ranges: Mapping[str, tuple[float, float]] = SENSOR_RANGES
) -> DataFrame:
    """One row per reading and sensor with the limits of the sensor and the deviation from them."""
    long = readings.select(*keep, *[F.col(s).cast("double").alias(s) for s in ranges]).unpivot(
        list(keep), list(ranges), "variable", "value"
    )
    return long.join(range_table(readings.sparkSession, ranges), "variable").withColumn(
        "deviation_pct", range_deviation(F.col("value"), F.col("low"), F.col("high"))
    )


def outside(value: Column, low: Column | float, high: Column | float) -> Column:
    """Whether a value lies outside its limits; NULL for one that is no number, which breaches nothing."""
    return (known(value) < low) | (known(value) > high)


def out_of_range() -> Column:
    return outside(F.col("value"), F.col("low"), F.col("high"))


def sensor_breaches(
    readings: DataFrame, keep: Sequence[str], ranges: Mapping[str, tuple[float, float]] = SENSOR_RANGES
) -> DataFrame:
    """The sensor values that lie outside their range."""
    return sensor_values(readings, keep, ranges).filter(out_of_range())


def first_breach(
    readings: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    ranges: Mapping[str, tuple[float, float]] = SENSOR_RANGES,
) -> DataFrame:
    """Per key the variable that left its range first, and the row where it did.

    `order` must be total within a key. Variables that leave in the same row are taken in the order
    of `ranges`.
    """
    # Only the first row with a breach goes on; which variable it was is settled on that row.
    first = top_per_key(readings.filter(any_breach(ranges)).select(*keys, *order, *ranges), keys, list(order), 1)
    details = []
    for name, (low, high) in ranges.items():
        value = F.col(name).cast("double")
        detail = F.struct(
            F.lit(name).alias("variable"),
            value.alias("value"),
            range_deviation(value, F.lit(low), F.lit(high)).alias("deviation_pct"),
        )
        details.append(F.when(outside(value, low, high), detail))
    found = first.withColumn("_b", F.coalesce(*details))
    return found.select(*keys, "_b.variable", *order, "_b.value", "_b.deviation_pct")


@dataclass(frozen=True)
class Spans:
    """Alerts and readings whose context is not paired: what belongs to an alert is told by the span of time around it."""

    alerts: DataFrame
    readings: DataFrame
    before_s: int
    after_s: int
    keys: tuple[str, ...]
    rows_per_slice: int

    def pairs(self, alerts: DataFrame) -> DataFrame:
        """The context of some alerts, a row per alert and reading."""
        return alerts_with_context(alerts, self.readings, self.before_s, self.after_s, self.keys, self.rows_per_slice)


def score_timeline(
    readings: DataFrame | Spans,
    keys: Sequence[str],
    order: Sequence[str],
    score: str = "anomaly_score",
    threshold: float = ALERT_SCORE,
    rows_per_slice: int = ROWS_PER_SLICE,
    checkpoint: bool = False,
) -> DataFrame:
    """How the score of a key developed, one row per key.

    `base_score` is the first score. `crossing` is the first row at or above the threshold whose
    predecessor was below it (or missing). `rise_start` is the low point from which the score
    climbed without a break to the crossing, `rise_rows` the number of rows in between. `peak` is
    the first row with the highest score. Rows are given as structs of the order columns.
    `checkpoint` stores the input first; use it when the input is more than a scan. Of `Spans`, a key is
    an alert and its series the readings of its span; they are not paired.
    """
    if isinstance(readings, Spans):
        if list(keys) != ["alert_id"]:
            raise ValueError("spans are those of alerts")
        return _span_timelines(readings, order, score, threshold, rows_per_slice)
    series = readings.select(*keys, *order, F.col(score).alias("_s")).filter(F.col("_s").isNotNull())
    padded = with_past_rows(slice_rows(series, keys, order, rows_per_slice, checkpoint), 1)
    group = [*keys, SLICE]
    ordered = Window.partitionBy(*group).orderBy(*order)
    linked = (
        padded.withColumn("_prev", F.lag("_s").over(ordered))
        .withColumn("_at", F.sum((~F.col(CARRY)).cast("long")).over(ordered))
        .filter(~F.col(CARRY))
    )
    turns = F.col("_prev").isNull() | (F.col("_s") <= F.col("_prev"))
    crosses = (F.col("_s") >= threshold) & (F.col("_prev").isNull() | (F.col("_prev") < threshold))
    row = F.struct("_at", *order)
    climbed = linked.withColumn("_turn", F.max(F.when(turns, row)).over(ordered))
    # What a slice knows by itself; `_at` counts from its first row. No further shuffle is needed
    # here, and one row per slice of a key goes on.
    per_slice = climbed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("_at", "_s")).alias("_base"),
        F.max(F.struct("_s", (-F.col("_at")).alias("_neg"), *order)).alias("_peak"),
        F.min(F.when(crosses, F.struct("_at", *order, "_turn"))).alias("_cross"),
        F.max("_turn").alias("_last_turn"),
    )
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    past = by_slice.rowsBetween(Window.unboundedPreceding, -1)

    def shifted(struct: str) -> Column:
        """The row struct with its place in the whole key."""
        places = [(F.col(f"{struct}._at") + F.col("_start")).alias("_at"), *[F.col(f"{struct}.{c}").alias(c) for c in order]]
        return F.when(F.col(struct).isNotNull(), F.struct(*places))

    placed = (
        per_slice.withColumn("_start", F.coalesce(F.sum("_n").over(past), F.lit(0)))
        .withColumn("_turned", F.last(shifted("_last_turn"), ignorenulls=True).over(past))
        .withColumn("_own_turn", F.col("_cross._turn"))
        .withColumn("_turn", F.coalesce(shifted("_own_turn"), F.col("_turned")))
        .withColumn("_crossing", shifted("_cross"))
    )
    summary = placed.groupBy(*keys).agg(
        F.sum("_n").alias("readings"),
        F.min(F.struct(SLICE, "_base")).alias("_base"),
        F.min(F.when(F.col("_crossing").isNotNull(), F.struct("_crossing", "_turn"))).alias("_rise"),
        F.max(
            F.struct("_peak._s", (F.col("_peak._neg") - F.col("_start")).alias("_neg"), *[f"_peak.{c}" for c in order])
        ).alias("_peak"),
    )

    def place(struct: str) -> Column:
        return F.when(F.col(struct).isNotNull(), F.struct(*[F.col(f"{struct}.{c}").alias(c) for c in order]))

    return summary.select(
        *keys,
        "readings",
        F.col("_base._base._s").alias("base_score"),
        place("_rise._turn").alias("rise_start"),
        place("_rise._crossing").alias("crossing"),
        (F.col("_rise._crossing._at") - F.col("_rise._turn._at")).alias("rise_rows"),
        F.col("_peak._s").alias("peak_score"),
        place("_peak").alias("peak"),
    )


def _span_timelines(
    spans: Spans, order: Sequence[str], score: str, threshold: float, rows_per_slice: int
) -> DataFrame:
    """`score_timeline` of every alert, from running values over the readings of a node and the ends of its alerts' spans.

    Going back in time, the begin of a span meets its first reading and the next crossing. Time is cut into blocks as long as a span, so a
    span is the end of one block and the start of the next, and its peak is the larger one of a running maximum from either side. The work
    grows with readings and alerts, not with the readings in a span.
    """
    node = list(spans.keys)
    width = (spans.before_s + spans.after_s) * 1_000_000
    at = F.unix_micros(F.col("event_ts").cast("timestamp"))
    known_place = reduce(and_, [F.col(c).isNotNull() for c in [*node, "_at"]])
    of = F.struct(*node, "_at")
    alerts = spans.alerts.withColumn("_at", at).filter(known_place)
    ids = cut_lineage(
        alerts.groupBy("alert_id").agg(F.count(F.lit(1)).alias("_times"), F.min(of).alias("_of"), F.max(of).alias("_to"))
    )
    # Several alerts of one number are one series. If they have one span, each reading is in it that many times; if not, they are paired.
    several = F.col("_of") != F.col("_to")
    ends = [((F.col("_of._at") - spans.before_s * 1_000_000), 0), ((F.col("_of._at") + spans.after_s * 1_000_000), 2)]
    marks = ids.filter(~several).select(
        *[F.col(f"_of.{c}").alias(c) for c in node],
        "alert_id",
        "_times",
        F.inline(F.array(*[F.struct(end.alias("_at"), F.lit(kind).alias("_kind")) for end, kind in ends])),
    )
    rows = spans.readings.select(
        *node, at.alias("_at"), F.lit(1).alias("_kind"), F.struct(*order).alias("_row"), F.col(score).alias("_s")
    ).filter(known_place & F.col("_s").isNotNull())
    both = rows.unionByName(marks, allowMissingColumns=True)
    reading, n, s = F.col("_kind") == 1, F.col("_n"), F.col("_s")
    sliced = slice_rows(both, node, ["_at", "_kind", "_row", "_s"], rows_per_slice)
    counted = running(
        sliced,
        {"_n": ("sum", reading.cast("long")), "_prev": ("max", F.when(reading, F.struct("_at", "_row", "_s")))},
        before=["_prev"],
    )
    # Readings alike in everything are told apart by their place from here on.
    counted = replace(counted, order=("_at", "_kind", "_n"))
    prev = F.col("_prev._s")
    block = F.col("_at") - F.pmod("_at", F.lit(width).cast("long"))
    turned = running(
        stored(counted),
        {
            "_turn": ("max", F.when(reading & (prev.isNull() | (s <= prev)), F.struct("_n", "_row"))),
            "_so_far": ("max", F.when(reading, F.struct(block.alias("_block"), "_s", (-n).alias("_neg"), "_row"))),
        },
    )
    crosses = reading & (s >= threshold) & (prev.isNull() | (prev < threshold))
    is_copy = F.struct("_at", "_row", "_s").eqNullSafe(F.col("_prev"))
    ahead = running(
        stored(turned),
        {
            "_first": ("min", F.when(reading, F.struct("_n", "_row", "_s"))),
            "_cross": ("min", F.when(crosses, F.struct("_n", "_row", "_turn"))),
            "_copy": ("min", F.when(reading & (s >= threshold) & is_copy, n)),
            "_to_come": ("max", F.when(reading, F.struct((-block).alias("_back"), "_s", (-n).alias("_neg"), "_row"))),
        },
        backward=True,
    ).rows()

    def peak(struct: str, in_block: Column) -> Column:
        return F.when(in_block, F.struct(*[f"{struct}.{c}" for c in ("_s", "_neg", "_row")])).alias("_peak")

    begin = F.struct("_n", "_first", "_cross", "_copy", peak("_to_come", F.col("_to_come._back") == -block))
    end = F.struct("_n", peak("_so_far", F.col("_so_far._block") == block))
    found = (
        ahead.filter(~reading)
        .groupBy("alert_id")
        .agg(F.max("_times").alias("_times"), F.max(F.when(F.col("_kind") == 0, begin)).alias("_begin"), F.max(F.when(F.col("_kind") == 2, end)).alias("_end"))
        .withColumn("_count", F.col("_end._n") - F.col("_begin._n"))
        .filter(F.col("_count") > 0)
        .withColumn("_first", F.col("_begin._first"))
    )
    # The first reading of a span has none before it: it crosses if it is high, and is a low point.
    at_once = F.col("_first._s") >= threshold
    crossing = F.when(at_once, F.struct("_first._n", "_first._row")).when(
        F.col("_begin._cross._n") <= F.col("_end._n"), F.struct("_begin._cross._n", "_begin._cross._row")
    )
    low = F.greatest(F.struct("_first._n", "_first._row"), F.col("_begin._cross._turn"))
    # Readings of one place in the order count together: one that is there several times is its own low point. No reading before the
    # crossing is as high, so a copy of it is the first high copy.
    repeated = (F.col("_times") > 1) | F.coalesce(F.col("_begin._copy") == F.col("_crossing._n") + 1, F.lit(False))
    rise = F.when(at_once | repeated, F.col("_crossing")).when(F.col("_crossing").isNotNull(), low)
    timelines = (
        found.withColumn("_crossing", crossing)
        .withColumn("_rise", rise)
        .withColumn("_peak", F.greatest("_begin._peak", "_end._peak"))
        .select(
            "alert_id",
            (F.col("_count") * F.col("_times")).alias("readings"),
            F.col("_first._s").alias("base_score"),
            F.col("_rise._row").alias("rise_start"),
            F.col("_crossing._row").alias("crossing"),
            (F.col("_crossing._n") - F.col("_rise._n")).alias("rise_rows"),
            F.col("_peak._s").alias("peak_score"),
            F.col("_peak._row").alias("peak"),
        )
    )
    mixed = ids.filter(several).select(F.col("alert_id").alias("_id"))
    if mixed.isEmpty():
        return timelines
    paired = spans.pairs(alerts.drop("_at").join(mixed, F.col("alert_id").eqNullSafe(F.col("_id")), "left_semi"))
    return timelines.unionByName(score_timeline(paired, ["alert_id"], order, score, threshold, rows_per_slice, True))


def rise_kind(timeline: DataFrame, abrupt_rows: int = ABRUPT_ROWS) -> DataFrame:
    """Add `rise`: "abrupt" when the climb took at most `abrupt_rows` rows, else "gradual"."""
    return timeline.withColumn(
        "rise", F.when(F.col("rise_rows") <= abrupt_rows, "abrupt").when(F.col("rise_rows").isNotNull(), "gradual")
    )


def trend_slope(
    readings: DataFrame, keys: Sequence[str], order: Sequence[str], score: str = "anomaly_score", n: int = 50
) -> DataFrame:
    """Slope of the score per reading over the last n readings, with their first and last score."""
    recent = last_n(readings.select(*keys, *order, F.col(score).alias("_s")), keys, order, n)
    row = F.struct("recency", "_s")
    return recent.groupBy(*keys).agg(
        F.regr_slope("_s", -F.col("recency")).alias("slope"),
        F.max(row)["_s"].alias("first_score"),
        F.min(row)["_s"].alias("last_score"),
        F.count(F.lit(1)).alias("n"),
    )


def urgency(slope: Column, status: Column, slow: float = SLOW_RISE, steep: float = STEEP_RISE) -> Column:
    """"hours", "days" or "planned" from the trend and the present state."""
    return (
        F.when((status == CRITICAL_STATE) | (slope >= steep), "hours")
        .when((slope >= slow) | (status == ALERT_STATE), "days")
        .otherwise("planned")
    )


def any_breach(ranges: Mapping[str, tuple[float, float]] = SENSOR_RANGES) -> Column:
    """True for rows with a sensor out of range; unknown values are not."""
    each = [F.coalesce(outside(F.col(s), lo, hi), F.lit(False)) for s, (lo, hi) in ranges.items()]
    return reduce(or_, each)


def breached_names(ranges: Mapping[str, tuple[float, float]] = SENSOR_RANGES) -> Column:
    """Sorted names of the sensors of a row that are out of range."""
    names = [F.when(outside(F.col(s), lo, hi), F.lit(s)) for s, (lo, hi) in sorted(ranges.items())]
    return F.array_compact(F.array(*names))


def co_moving(
    readings: DataFrame, keys: Sequence[str], ranges: Mapping[str, tuple[float, float]] = SENSOR_RANGES
) -> DataFrame:
    """Sets of two or more variables that are out of range in the same reading, with their count."""
    return (
        readings.select(*keys, breached_names(ranges).alias("variables"))
        .filter(F.size("variables") >= 2)
        .groupBy(*keys, "variables")
        .agg(F.count(F.lit(1)).alias("readings"))
    )


def sensor_correlations(readings: DataFrame, keys: Sequence[str], sensors: Sequence[str] = SENSORS) -> DataFrame:
    """Correlation of every pair of sensors per key, as (first, second, correlation)."""
    pairs = [(a, b) for i, a in enumerate(sensors) for b in sensors[i + 1 :]]
    wide = readings.groupBy(*keys).agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}:{b}") for a, b in pairs]
    )
    rows = [
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"{a}:{b}").alias("correlation"))
        for a, b in pairs
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))


def alerts_with_context(
    alerts: DataFrame,
    readings: DataFrame,
    before_s: int,
    after_s: int,
    keys: Sequence[str] = ("node_id",),
    rows_per_slice: int = ROWS_PER_SLICE,
    first: Column | None = None,
    paired: bool = True,
) -> DataFrame | Spans:
    """Readings of the same node from `before_s` seconds before to `after_s` seconds after an alert.

    With `first`, a condition on a reading, an alert gets the earliest reading of its span that meets it and no other. These are found by
    one running minimum over readings and alerts in order of time, so the work does not grow with the readings in a span.
    Without `paired` nothing is joined: `score_timeline` takes the context in that form.

    Both sides meet in time buckets of a `BUCKETS`th of the span, so nothing is compared across the whole series, and a reading meets few
    alerts whose span does not hold it. A node with more than `rows_per_slice` readings is cut into slices in order of time and number, so that a burst in one
    bucket is shared by several tasks; an alert goes to the slices that its span reaches into, and is repeated nowhere else.
    """
    width = (before_s + after_s) * 1_000_000
    if width <= 0:
        raise ValueError("the span must be positive")
    if not paired:
        return Spans(alerts, readings, before_s, after_s, tuple(keys), rows_per_slice)
    if first is not None:
        return _earliest_in_context(alerts, readings.filter(first), before_s, after_s, keys, rows_per_slice)

    def bucket(moment: Column) -> Column:
        return F.floor(moment / F.lit(max(1, width // BUCKETS))).cast("long")

    at = F.unix_micros(F.col("event_ts").cast("timestamp"))
    begin, end = F.col("_at") - before_s * 1_000_000, F.col("_at") + after_s * 1_000_000
    around = alerts.select(*keys, "alert_id", at.alias("_at"))
    sliced = slice_rows(readings, keys, ["event_ts", "reading_id"], rows_per_slice)
    if sliced.single:
        around = around.withColumn(SLICE, F.lit(0))
    else:
        spans = sliced.df.groupBy(*keys, SLICE).agg(F.min(at).alias("_from"), F.max(at).alias("_to"))
        around = around.join(spans, list(keys)).filter((begin <= F.col("_to")) & (end >= F.col("_from"))).drop("_from", "_to")
    around = around.withColumn("_bucket", F.explode(F.sequence(bucket(begin), bucket(end))))
    placed = sliced.df.withColumn("_bucket", bucket(at))
    offset = at - F.col("_at")
    return (
        placed.join(around, [*keys, SLICE, "_bucket"])
        .filter(offset.between(-before_s * 1_000_000, after_s * 1_000_000))
        .withColumn("phase", _phase(offset))
        .drop("_bucket", SLICE, "_at")
    )


def _phase(offset: Column) -> Column:
    return F.when(offset < 0, "before").when(offset > 0, "after").otherwise("during")


def _earliest_in_context(
    alerts: DataFrame, readings: DataFrame, before_s: int, after_s: int, keys: Sequence[str], rows_per_slice: int
) -> DataFrame:
    """Per alert the earliest of the readings in its span, in order of time and number.

    Rows run from the newest to the oldest, an alert where its span begins: the least reading so far is the first one from there on.
    """
    at = F.unix_micros(F.col("event_ts").cast("timestamp"))
    rest = [c for c in readings.columns if c not in keys]
    rows = readings.select(
        *keys, (-at).alias("_back"), F.lit(0).alias("_kind"), F.col("reading_id").alias("_reading"),
        F.struct(at.alias("_at"), "reading_id", F.struct(*rest).alias("_row")).alias("_found"),
    )
    marks = alerts.select(
        *keys, (-at + before_s * 1_000_000).alias("_back"), F.lit(1).alias("_kind"), F.col("alert_id"), at.alias("_alert")
    )
    both = rows.unionByName(marks, allowMissingColumns=True).dropna(subset=[*keys, "_back"])
    order = ["_back", "_kind", "_reading", "alert_id"]
    seen = running(slice_rows(both, keys, order, rows_per_slice), {"_next": ("min", F.col("_found"))}).rows()
    offset = F.col("_next._at") - F.col("_alert")
    return seen.filter((F.col("_kind") == 1) & (offset <= after_s * 1_000_000)).select(
        *keys, *[F.col("_next._row")[c].alias(c) for c in rest], "alert_id", _phase(offset).alias("phase")
    )


def best_epoch(
    log: DataFrame,
    metric: str,
    patience: int = 12,
    run: str = "run_id",
    epoch: str = "epoch",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Best epoch of every run and the epoch at which early stopping ends it.

    An epoch is a gain when its metric exceeds all earlier ones and 0. The run stops at the first
    epoch that is `patience` epochs past the last gain; later rows do not count.
    """
    series = log.select(run, epoch, F.col(metric).alias("_m"))
    seen = running(
        slice_rows(series, [run], [epoch], rows_per_slice),
        {"_n": ("sum", F.lit(1).cast("long")), "_best": ("max", F.col("_m"))},
        before=["_best"],
    )
    gain = F.when(F.col("_m") > F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(0.0)), F.struct("_n", epoch, "_m"))
    gained = running(stored(seen), {"_gain": ("max", gain)}).rows()
    idle = F.col("_n") - F.coalesce(F.col("_gain._n"), F.lit(0))
    ends = gained.groupBy(run).agg(
        F.min(F.when(idle >= patience, F.struct("_n", epoch, "_gain"))).alias("_stop"),
        F.max("_gain").alias("_last"),
    )
    best = F.when(F.col("_stop").isNotNull(), F.col("_stop._gain")).otherwise(F.col("_last"))
    return ends.withColumn("_b", best).select(
        run,
        F.col(f"_b.{epoch}").alias("best_epoch"),
        F.col("_b._m").alias("best_metric"),
        F.col(f"_stop.{epoch}").alias("stop_epoch"),
    )


def training_log_split(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a training loss, rows with an evaluation loss)."""
    return log.filter(F.col("loss").isNotNull()), log.filter(F.col("eval_loss").isNotNull())


def run_extremes(log: DataFrame, run: str = "run_id", step: str = "step") -> DataFrame:
    """Smallest and largest gradient norm in training rows; first and last evaluation loss, and
    how many times smaller the last one is."""
    trained, evaluated = F.col("loss").isNotNull(), F.col("eval_loss").isNotNull()
    evaluation = F.when(evaluated, F.struct(step, "eval_loss"))
    return (
        log.groupBy(run)
        .agg(
            F.min(F.when(trained, F.col("grad_norm"))).alias("min_grad_norm"),
            F.max(F.when(trained, F.col("grad_norm"))).alias("max_grad_norm"),
            F.min(evaluation)["eval_loss"].alias("first_eval_loss"),
            F.max(evaluation)["eval_loss"].alias("last_eval_loss"),
        )
        .withColumn("eval_loss_ratio", F.try_divide("first_eval_loss", "last_eval_loss"))
    )
