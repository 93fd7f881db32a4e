"""Frames, latest rows, splits, scaling and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch.functions.numbers import report_round
from plantwatch.functions.rules import SENSORS, health_status
from plantwatch.operators import episodes, ordered, prep
from plantwatch.operators.filters import feature_names
from plantwatch.plans.training import with_type_code
from plantwatch.registry.book import register, rounded

R = rounded
LABELS = ("twf", "hdf", "pwf", "osf", "rnf")


def _outline(frames, size):
    """First, last and summed values of the frames as plain columns."""
    last = size - 1
    return frames.select(
        "reading_id",
        "node_id",
        F.size("frame").alias("n"),
        F.get(F.get("frame", F.lit(0)), F.lit(1)).alias("oldest_process_temp_k"),
        F.get(F.get("frame", F.lit(last)), F.lit(2)).alias("newest_rpm"),
        F.aggregate("frame", F.lit(0).cast("long"), lambda s, r: s + F.get(r, F.lit(4)).cast("long")).alias("wear_sum"),
    )


def _frame_sql(partition, first, last):
    return f"""
, f AS (SELECT reading_id, node_id, count(*) OVER w AS n, first_value(process_temp_k) OVER w AS oldest,
    last_value(rpm) OVER w AS newest, sum(tool_wear_min) OVER w AS wear FROM readings
  WINDOW w AS ({partition} ORDER BY event_ts, reading_id ROWS BETWEEN {first} AND {last}))
SELECT reading_id, node_id, CAST(n AS INT) AS n, oldest AS oldest_process_temp_k, CAST(newest AS DOUBLE) AS newest_rpm,
  CAST(wear AS BIGINT) AS wear_sum FROM f WHERE n = 20
"""


register("lag_windows", ["readings"], _frame_sql("PARTITION BY node_id", "20 PRECEDING", "1 PRECEDING"))(
    lambda r: _outline(
        ordered.lag_windows(r, ["node_id"], ["event_ts", "reading_id"], SENSORS, 20), 20
    )
)

register("lag_windows_bucketed", ["readings"], _frame_sql("", "20 PRECEDING", "1 PRECEDING"))(
    lambda r: _outline(
        ordered.lag_windows_bucketed(r, ["event_ts", "reading_id"], SENSORS, 20), 20
    )
)

register("trailing_frames", ["readings"], _frame_sql("PARTITION BY node_id", "19 PRECEDING", "CURRENT ROW"))(
    lambda r: _outline(
        ordered.trailing_frames(r, ["node_id"], ["event_ts", "reading_id"], SENSORS, 20), 20
    )
)

register("last_n", ["readings"], """
SELECT * FROM (SELECT node_id, reading_id, anomaly_score, CAST(row_number() OVER (
  PARTITION BY node_id ORDER BY event_ts DESC, reading_id DESC) AS INT) AS recency FROM readings) WHERE recency <= 20
""")(
    lambda r: ordered.last_n(
        r.select("node_id", "reading_id", "anomaly_score", "event_ts"), ["node_id"], ["event_ts", "reading_id"], 20
    ).drop("event_ts")
)

register("with_position", ["readings"], """
SELECT node_name, reading_id, CAST(row_number() OVER (PARTITION BY node_name ORDER BY event_ts, reading_id) - 1
  AS BIGINT) AS position FROM readings
""")(
    lambda r: ordered.with_position(
        r.select("node_name", "reading_id", "event_ts"), ["node_name"], ["event_ts", "reading_id"]
    ).drop("event_ts")
)

register("stratified_split", ["readings"], """
, n AS (SELECT machine_failure, count(*) AS n FROM readings GROUP BY machine_failure),
t AS (SELECT machine_failure, n, CAST(round_even(n * 0.2e0, 0) AS BIGINT) AS t FROM n)
SELECT machine_failure, 'test' AS split, t AS n FROM t UNION ALL SELECT machine_failure, 'train', n - t FROM t
""")(
    lambda r: prep.stratified_split(r.select("reading_id", "machine_failure"), "machine_failure", ["reading_id"])
    .groupBy("machine_failure", "split")
    .agg(F.count(F.lit(1)).alias("n"))
)

_coverage = f"""
, c AS (SELECT *, CAST(CASE product_type WHEN 'L' THEN 0 WHEN 'M' THEN 1 ELSE 2 END AS DOUBLE) AS type_code,
    count(*) OVER (PARTITION BY node_id ORDER BY event_ts, reading_id ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS after,
    row_number() OVER (PARTITION BY node_id ORDER BY event_ts, reading_id) AS pos,
    count(*) OVER (PARTITION BY node_id) AS n FROM readings),
w AS (SELECT *, greatest(0, least(n, pos + 20) - greatest(20, pos)) AS weight FROM c)
"""


def _moments(column, position):
    mean = f"sum(weight * CAST({column} AS DOUBLE)) / sum(weight)"
    square = f"sum(weight * (CAST({column} AS DOUBLE) - m) * (CAST({column} AS DOUBLE) - m)) / sum(weight)"
    return f"""SELECT CAST({position} AS INT) AS feature, {R('max(m)', 6)} AS mean, {R(f'sqrt({square}) + 1e-8', 6)} AS std
    FROM w, (SELECT {mean} AS m FROM w)"""


def _moments_rounded(stats):
    return stats.select("feature", report_round(F.col("mean"), 6).alias("mean"), report_round(F.col("std"), 6).alias("std"))


register(
    "zscore_stats",
    ["readings"],
    _coverage + " UNION ALL ".join(_moments(c, i) for i, c in enumerate([*SENSORS, "type_code"])),
)(
    lambda r: _moments_rounded(
        prep.weighted_stats(
            prep.frame_weights(with_type_code(r), ["node_id"], ["event_ts", "reading_id"], 20), feature_names()
        )
    )
)

register(
    "zscore_of_frames",
    ["readings"],
    _coverage + " UNION ALL ".join(_moments(c, i) for i, c in enumerate([*SENSORS, "type_code"])),
)(
    lambda r: _moments_rounded(
        prep.zscore_stats(
            ordered.lag_windows(with_type_code(r), ["node_id"], ["event_ts", "reading_id"], feature_names(), 20)
        )
    )
)


def _scaled(readings):
    frames = ordered.trailing_frames(
        readings, ["node_id"], ["event_ts", "reading_id"], SENSORS, 20
    )
    scaled = prep.apply_zscore(frames, prep.fit_zscore(frames, len(SENSORS)))
    newest = F.get("frame", F.lit(19))
    return scaled.select(
        "reading_id",
        *[report_round(F.get(newest, F.lit(i)), 6).alias(f"z_{name}") for i, name in enumerate(SENSORS)],
    )


register("apply_zscore", ["readings"], f"""
, c AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY event_ts, reading_id) AS pos,
    count(*) OVER (PARTITION BY node_id) AS n FROM readings),
w AS (SELECT *, greatest(0, least(n, pos + 19) - greatest(20, pos) + 1) AS weight FROM c),
m AS (SELECT {', '.join(f'sum(weight * CAST({s} AS DOUBLE)) / sum(weight) AS m_{s}' for s in SENSORS)} FROM w),
d AS (SELECT {', '.join(f'sqrt(sum(weight * (CAST({s} AS DOUBLE) - m_{s}) * (CAST({s} AS DOUBLE) - m_{s})) / sum(weight)) + 1e-8 AS d_{s}' for s in SENSORS)} FROM w, m)
SELECT reading_id, {', '.join(f"{R(f'({s} - m_{s}) / d_{s}', 6)} AS z_{s}" for s in SENSORS)}
FROM w, m, d WHERE pos >= 20
""")(_scaled)

register("positive_weights", ["cases"], " UNION ALL ".join(
    f"""SELECT '{x}' AS label, CAST(greatest(sum({x}), 1) AS BIGINT) AS positives,
      {R(f'(count(*) - greatest(sum({x}), 1)) / greatest(sum({x}), 1)', 6)} AS weight FROM cases"""
    for x in LABELS
))(
    lambda c: prep.positive_weights(c, LABELS).withColumn("weight", report_round(F.col("weight"), 6))
)

register("operating_point", ["readings"], f"""
, q AS (SELECT quantile_cont(anomaly_score, 1 - 0.034e0) AS t FROM readings)
SELECT {R('t', 6)} AS threshold, CAST((SELECT count(*) FROM readings WHERE anomaly_score > t) AS BIGINT) AS flagged FROM q
""")(
    lambda r: prep.operating_point(r, "anomaly_score", 0.034).withColumn(
        "threshold", report_round(F.col("threshold"), 6)
    )
)

ORDER = ["event_ts", "reading_id"]
register("first_breach", ["stressed"], """
, b AS (SELECT node_id, event_ts, reading_id, 0 AS o, 'air_temp_k' AS variable, air_temp_k AS v, 295e0 AS lo, 304e0 AS hi FROM stressed
  UNION ALL SELECT node_id, event_ts, reading_id, 1, 'process_temp_k', process_temp_k, 305e0, 313e0 FROM stressed
  UNION ALL SELECT node_id, event_ts, reading_id, 2, 'rpm', rpm, 1168e0, 2886e0 FROM stressed
  UNION ALL SELECT node_id, event_ts, reading_id, 3, 'torque_nm', torque_nm, 3.8e0, 76.6e0 FROM stressed
  UNION ALL SELECT node_id, event_ts, reading_id, 4, 'tool_wear_min', tool_wear_min, 0e0, 253e0 FROM stressed),
x AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY event_ts, reading_id, o) AS rn FROM b
  WHERE v < lo OR v > hi)
SELECT node_id, variable, reading_id FROM x WHERE rn = 1
""")(lambda s: episodes.first_breach(s, ["node_id"], ORDER).select("node_id", "variable", "reading_id"))

TIMELINE = """
, p AS (SELECT *, lag(anomaly_score) OVER k AS prev, row_number() OVER k AS pos FROM readings
  WINDOW k AS (PARTITION BY node_id ORDER BY event_ts, reading_id)),
t AS (SELECT *, max(CASE WHEN prev IS NULL OR anomaly_score <= prev THEN pos END) OVER (PARTITION BY node_id
  ORDER BY event_ts, reading_id) AS turn FROM p),
c AS (SELECT node_id, min(pos) AS cross_pos FROM t WHERE anomaly_score >= 0.65 AND (prev < 0.65 OR prev IS NULL) GROUP BY node_id),
g AS (SELECT node_id, count(*) AS readings, arg_min(anomaly_score, pos) AS base_score, max(anomaly_score) AS peak_score,
    min(pos) AS first_pos FROM t GROUP BY node_id),
k AS (SELECT t.node_id, min(t.pos) AS peak_pos FROM t JOIN g ON t.node_id IS NOT DISTINCT FROM g.node_id
  AND t.anomaly_score = g.peak_score GROUP BY t.node_id),
r AS (SELECT g.*, c.cross_pos, k.peak_pos, x.turn, x.reading_id AS crossing_reading, x.anomaly_score AS crossing_score
  FROM g LEFT JOIN c ON g.node_id IS NOT DISTINCT FROM c.node_id JOIN k ON g.node_id IS NOT DISTINCT FROM k.node_id
  LEFT JOIN t x ON x.node_id IS NOT DISTINCT FROM c.node_id AND x.pos = c.cross_pos)
SELECT r.node_id, CAST(readings AS BIGINT) AS readings, base_score, s.reading_id AS rise_reading, crossing_reading,
  CAST(cross_pos - r.turn AS BIGINT) AS rise_rows, peak_score, q.reading_id AS peak_reading
FROM r LEFT JOIN t s ON s.node_id IS NOT DISTINCT FROM r.node_id AND s.pos = r.turn
JOIN t q ON q.node_id IS NOT DISTINCT FROM r.node_id AND q.pos = r.peak_pos
"""


def _timeline(readings):
    return episodes.score_timeline(readings, ["node_id"], ORDER)


register("score_timeline", ["readings"], TIMELINE)(
    lambda r: _timeline(r).select(
        "node_id",
        "readings",
        "base_score",
        F.col("rise_start.reading_id").alias("rise_reading"),
        F.col("crossing.reading_id").alias("crossing_reading"),
        "rise_rows",
        "peak_score",
        F.col("peak.reading_id").alias("peak_reading"),
    )
)

register("rise_kind", ["readings"], TIMELINE.replace("SELECT r.node_id, CAST(readings", """SELECT r.node_id,
  CASE WHEN cross_pos - r.turn <= 1 THEN 'abrupt' WHEN cross_pos IS NOT NULL THEN 'gradual' END AS rise,
  CAST(readings""").replace(", peak_score, q.reading_id AS peak_reading", "").replace(
    "CAST(readings AS BIGINT) AS readings, base_score, s.reading_id AS rise_reading, crossing_reading,", ""))(
    lambda r: episodes.rise_kind(_timeline(r), abrupt_rows=1).select("node_id", "rise", "rise_rows")
)

SLOPE = f"""
, l AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY event_ts DESC, reading_id DESC) AS rec FROM readings),
s AS (SELECT node_id, {R('regr_slope(anomaly_score, -rec)', 6)} AS slope, arg_max(anomaly_score, rec) AS first_score,
  arg_min(anomaly_score, rec) AS last_score, CAST(count(*) AS BIGINT) AS n FROM l WHERE rec <= 50 GROUP BY node_id)
"""


def _slope(readings):
    return episodes.trend_slope(readings, ["node_id"], ORDER, n=50).withColumn(
        "slope", report_round(F.col("slope"), 6)
    )


register("trend_slope", ["readings"], SLOPE + "SELECT * FROM s")(_slope)

register("urgency", ["readings"], SLOPE + """
, a AS (SELECT node_id, avg(anomaly_score) AS m FROM readings GROUP BY node_id)
SELECT s.node_id, CASE WHEN m >= 0.8 OR slope >= 0.005e0 THEN 'hours' WHEN slope >= 0.0005e0 OR m >= 0.65 THEN 'days'
  ELSE 'planned' END AS urgency FROM s JOIN a ON s.node_id IS NOT DISTINCT FROM a.node_id
""")(
    lambda r: _slope(r)
    .join(r.groupBy(F.col("node_id").alias("_n")).agg(F.avg("anomaly_score").alias("m")), F.col("node_id").eqNullSafe(F.col("_n")))
    .select("node_id", episodes.urgency(F.col("slope"), health_status(F.col("m"))).alias("urgency"))
)

register("co_moving", ["stressed"], """
, v AS (SELECT node_id, CASE WHEN air_temp_k < 295 OR air_temp_k > 304 THEN 'air_temp_k ' ELSE '' END ||
    CASE WHEN process_temp_k < 305 OR process_temp_k > 313 THEN 'process_temp_k ' ELSE '' END ||
    CASE WHEN rpm < 1168 OR rpm > 2886 THEN 'rpm ' ELSE '' END ||
    CASE WHEN tool_wear_min < 0 OR tool_wear_min > 253 THEN 'tool_wear_min ' ELSE '' END ||
    CASE WHEN torque_nm < 3.8e0 OR torque_nm > 76.6e0 THEN 'torque_nm ' ELSE '' END AS vars FROM stressed)
SELECT node_id, trim(vars) AS variables, CAST(count(*) AS BIGINT) AS readings FROM v
WHERE length(trim(vars)) - length(replace(trim(vars), ' ', '')) >= 1 GROUP BY node_id, vars
""")(lambda s: episodes.co_moving(s, ["node_id"]).withColumn("variables", F.array_join("variables", " ")))

_pairs = [(a, b) for i, a in enumerate(SENSORS) for b in SENSORS[i + 1 :]]
register("sensor_correlations", ["stressed"], " UNION ALL ".join(
    f"SELECT node_name, '{a}' AS first, '{b}' AS second, {R(f'corr({a}, {b})', 6)} AS correlation FROM stressed GROUP BY node_name"
    for a, b in _pairs
))(
    lambda s: episodes.sensor_correlations(s, ["node_name"]).withColumn(
        "correlation", report_round(F.col("correlation"), 6)
    )
)

BEST = """
, n AS (SELECT *, row_number() OVER w AS pos, coalesce(max(f1_macro) OVER (PARTITION BY run_id ORDER BY epoch
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best_before FROM epochs
  WINDOW w AS (PARTITION BY run_id ORDER BY epoch)),
i AS (SELECT *, max(CASE WHEN f1_macro > greatest(best_before, 0) THEN pos ELSE 0 END) OVER (PARTITION BY run_id ORDER BY epoch)
    AS last_gain FROM n),
s AS (SELECT run_id, min(CASE WHEN pos - last_gain >= 12 THEN pos END) AS stop_pos FROM i GROUP BY run_id),
g AS (SELECT i.run_id, max(CASE WHEN stop_pos IS NULL OR pos <= stop_pos THEN last_gain END) AS gain_pos,
  max(stop_pos) AS stop_pos FROM i JOIN s USING (run_id) GROUP BY i.run_id),
r AS (SELECT g.run_id, b.epoch AS best_epoch, b.f1_macro AS best_metric, e.epoch AS stop_epoch FROM g
  LEFT JOIN n b ON b.run_id = g.run_id AND b.pos = g.gain_pos LEFT JOIN n e ON e.run_id = g.run_id AND e.pos = g.stop_pos)
"""
register("best_epoch", ["epochs"], BEST + "SELECT * FROM r")(
    lambda e: episodes.best_epoch(e, "f1_macro", patience=12)
)

register("run_extremes", ["epochs"], f"""
SELECT run_id, min(grad_norm) FILTER (loss IS NOT NULL) AS min_grad_norm, max(grad_norm) FILTER (loss IS NOT NULL) AS max_grad_norm,
  arg_min(eval_loss, epoch) FILTER (eval_loss IS NOT NULL) AS first_eval_loss,
  arg_max(eval_loss, epoch) FILTER (eval_loss IS NOT NULL) AS last_eval_loss,
  {R('arg_min(eval_loss, epoch) FILTER (eval_loss IS NOT NULL) / arg_max(eval_loss, epoch) FILTER (eval_loss IS NOT NULL)', 6)} AS eval_loss_ratio
FROM epochs GROUP BY run_id
""")(
    lambda e: episodes.run_extremes(e, step="epoch").withColumn(
        "eval_loss_ratio", report_round(F.col("eval_loss_ratio"), 6)
    )
)

register("training_log_split", ["epochs"], """
SELECT run_id, epoch, 'train' AS kind, loss FROM epochs WHERE loss IS NOT NULL
UNION ALL SELECT run_id, epoch, 'eval', eval_loss FROM epochs WHERE eval_loss IS NOT NULL
""")(
    lambda e: episodes.training_log_split(e)[0]
    .select("run_id", "epoch", F.lit("train").alias("kind"), "loss")
    .unionByName(
        episodes.training_log_split(e)[1].select(
            "run_id", "epoch", F.lit("eval").alias("kind"), F.col("eval_loss").alias("loss")
        )
    )
)
