"""Process deviations, counts, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch.functions.numbers import report_round
from plantwatch.operators import fleet, process, summaries
from plantwatch.registry.book import register, rounded

R = rounded
LABELS = ("twf", "hdf", "pwf", "osf", "rnf")

register("attach_nominals", ["process_measured", "nominals"], f"""
SELECT m.reading_id, m.equipment_id, m.tag, m.regime, {R('m.value', 3)} AS value,
  {R('n.nominal_value', 6)} AS nominal_value,
  CASE WHEN n.nominal_value = 0 THEN 0e0
    ELSE {R('(m.value - n.nominal_value) / abs(n.nominal_value) * 100e0', 2)} END AS deviation_pct
FROM process_measured m JOIN nominals n ON m.tag = n.tag AND m.regime = n.regime
""")(
    lambda m, n: process.attach_nominals(m.drop("value_pct", "event_ts"), n).withColumn(
        "nominal_value", report_round(F.col("nominal_value"), 6)
    )
)


def _sheet(part, shift):
    """Text table of one regime, with the blanks and non-numbers such tables have."""
    key = F.col("p_partkey")
    return part.select(
        F.when(key % 13 == shift, F.lit("  ")).otherwise(F.concat(F.lit(" T-"), key.cast("string"), F.lit(" "))).alias("tag"),
        F.when(key % 7 == 0, F.lit(None)).otherwise(F.concat(F.col("p_brand"), F.lit("  "))).alias("variable"),
        F.when(key % 11 == shift, F.lit("n/a")).when(key % 17 == 0, F.lit(None))
        .otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("nominal_value"),
    )


def _sheet_sql(equipment, regime, shift):
    return f"""SELECT '{equipment}' AS equipment_id, '{regime}' AS regime,
      CASE WHEN p_partkey % 13 = {shift} THEN '' ELSE 'T-' || CAST(p_partkey AS STRING) END AS tag,
      CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS variable,
      CASE WHEN p_partkey % 11 = {shift} THEN NULL WHEN p_partkey % 17 = 0 THEN NULL
        ELSE CAST(p_size AS DOUBLE) END AS nominal_value FROM part"""


SHEETS = [(f"ug-{u}", regime) for u in (1, 2) for regime in ("MT", "BL1", "BL2")]

register("load_nominals", ["part"], f"""
SELECT * FROM ({' UNION ALL '.join(_sheet_sql(e, r, i) for i, (e, r) in enumerate(SHEETS))})
WHERE tag <> '' AND nominal_value IS NOT NULL
""")(lambda part: process.load_nominals({key: _sheet(part, i) for i, key in enumerate(SHEETS)}))

register("union_sheets", ["part"], f"""
SELECT equipment_id, regime, CAST(count(*) AS BIGINT) AS n FROM (
  {' UNION ALL '.join(_sheet_sql(e, r, i) for i, (e, r) in enumerate(SHEETS))}) GROUP BY equipment_id, regime
""")(
    lambda part: process.union_sheets({key: _sheet(part, i) for i, key in enumerate(SHEETS)})
    .groupBy("equipment_id", "regime")
    .agg(F.count(F.lit(1)).alias("n"))
)

register("dataset_summary", ["cases"], f"""
, c AS (SELECT count(*) AS total_n, sum(CASE WHEN machine_failure = 0 THEN 1 ELSE 0 END) AS normal_n,
    sum(CASE WHEN machine_failure <> 0 THEN 1 ELSE 0 END) AS failures_n,
    {', '.join(f'sum({x}) AS {x}_n' for x in LABELS)} FROM cases)
{' UNION ALL '.join(f"SELECT '{i}' AS item, CAST({i}_n AS BIGINT) AS n, {R(f'100e0 * {i}_n / total_n', 2)} AS pct FROM c" for i in ("total", "normal", "failures", *LABELS))}
""")(lambda c: summaries.dataset_summary(c, LABELS))

register("value_counts", ["readings"], """
SELECT product_type, CAST(count(*) AS BIGINT) AS n FROM readings GROUP BY product_type
""")(lambda r: summaries.value_counts(r, "product_type"))

register("category_distribution", ["alerts"], """
, wanted AS (SELECT * FROM (VALUES ('severity', 0, 'low'), ('severity', 1, 'medium'), ('severity', 2, 'high'),
    ('severity', 3, 'critical'), ('failure_mode', 0, 'TWF'), ('failure_mode', 1, 'HDF'), ('failure_mode', 2, 'PWF'),
    ('failure_mode', 3, 'OSF'), ('failure_mode', 4, 'RNF'), ('failure_mode', 5, 'MULTIPLE'))
    AS v(field, ordinal, category)),
counts AS (SELECT 'severity' AS field, severity AS category, count(*) AS n FROM alerts GROUP BY severity
  UNION ALL SELECT 'failure_mode', failure_mode, count(*) FROM alerts GROUP BY failure_mode)
SELECT field, CAST(ordinal AS INT) AS ordinal, category, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM wanted LEFT JOIN counts USING (field, category)
""")(
    lambda a: summaries.category_distribution(
        a,
        {
            "severity": ["low", "medium", "high", "critical"],
            "failure_mode": ["TWF", "HDF", "PWF", "OSF", "RNF", "MULTIPLE"],
        },
    )
)

register("class_histogram", ["readings"], f"""
, lim AS (SELECT machine_failure, CASE machine_failure WHEN 0 THEN 50 ELSE 30 END AS bins,
    min(torque_nm) AS lo, max(torque_nm) AS hi, count(*) AS n_all FROM readings GROUP BY machine_failure),
s AS (SELECT *, (hi - lo) / bins AS step FROM lim),
grid AS (SELECT s.*, CAST(u.bin AS INT) AS bin, lo + u.bin * step AS a,
    CASE WHEN u.bin + 1 = bins THEN hi ELSE lo + (u.bin + 1) * step END AS b
  FROM s, (SELECT unnest(range(0, 50)) AS bin) u WHERE u.bin < bins),
hits AS (SELECT g.machine_failure, g.bin, count(*) AS n FROM grid g JOIN readings r
  ON r.machine_failure = g.machine_failure AND r.torque_nm >= g.a
  AND (r.torque_nm < g.b OR (g.bin + 1 = g.bins AND r.torque_nm <= g.b)) GROUP BY g.machine_failure, g.bin)
SELECT machine_failure, bin, {R('a', 6)} AS left_edge, {R('b', 6)} AS right_edge,
  CAST(coalesce(n, 0) AS BIGINT) AS n, {R('coalesce(n, 0) / (n_all * step)', 6)} AS density
FROM grid LEFT JOIN hits USING (machine_failure, bin)
""")(
    lambda r: summaries.class_histogram(r, "torque_nm", "machine_failure", {0: 50, 1: 30}).select(
        "machine_failure",
        "bin",
        *[report_round(F.col(c), 6).alias(c) for c in ("left_edge", "right_edge")],
        "n",
        report_round(F.col("density"), 6).alias("density"),
    )
)

register("detection_by_mode", ["cases"], f"""
{' UNION ALL '.join(f"SELECT * FROM (SELECT '{x}' AS mode, CAST(sum({x}) AS BIGINT) AS total, CAST(sum({x} * predicted_failure) AS BIGINT) AS detected, {R(f'1e0 * sum({x} * predicted_failure) / nullif(sum({x}), 0)', 3)} AS rate FROM cases) WHERE total > 0" for x in LABELS)}
""")(lambda c: summaries.detection_by_mode(c, LABELS))

register("elementwise_mean", ["embeddings"], f"""
, e AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS x FROM embeddings)
SELECT label, CAST(pos - 1 AS INT) AS position, {R('avg(CAST(x AS DOUBLE))', 6)} AS mean FROM e GROUP BY label, pos
""")(
    lambda e: summaries.elementwise_mean(e, ["label"], "embedding")
    .select("label", F.posexplode("mean").alias("position", "mean"))
    .withColumn("mean", report_round(F.col("mean"), 6))
)

register("random_sample", ["alerts"], """
SELECT alert_id, node_id, anomaly_score FROM alerts ORDER BY md5(CAST(alert_id AS VARCHAR) || '|42'), alert_id LIMIT 10
""")(
    lambda a: summaries.random_sample(a.select("alert_id", "node_id", "anomaly_score"), 10, ["alert_id"])
)

register("rank_values", ["readings"], f"""
SELECT node_name, {R('avg(anomaly_score)', 6)} AS importance FROM readings GROUP BY node_name
ORDER BY importance DESC, node_name
""")(
    lambda r: fleet.rank_values(
        r.groupBy("node_name").agg(report_round(F.avg("anomaly_score"), 6).alias("importance")),
        "importance",
        "node_name",
    )
)
