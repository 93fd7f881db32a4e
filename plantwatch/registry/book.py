"""Views over the test tables and the register of queries.

A view is one SQL text that runs unchanged in Spark SQL and in the engine that checks the results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

READINGS = """
WITH b AS (
  SELECT *, CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 1000 ELSE 300 END AS cap FROM events),
p AS (
  SELECT event_id AS reading_id, ts AS event_ts,
    'gw-' || CAST(user_id % 5 AS STRING) AS equipment_id,
    CASE WHEN user_id % 20 = 19 THEN '' WHEN user_id % 20 = 18 THEN NULL
         ELSE 'node-' || lpad(CAST(user_id % 20 AS STRING), 3, '0') END AS node_id,
    'Unit ' || CAST(user_id % 10 AS STRING) AS node_name,
    CASE event_id % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'M' ELSE 'H' END AS product_type,
    CAST(2950 + (event_id * 37) % 91 AS DOUBLE) / 10 AS air_temp_k,
    CAST(3050 + (event_id * 53) % 81 AS DOUBLE) / 10 AS process_temp_k,
    CAST(1168 + (event_id * 101) % 1719 AS INT) AS rpm,
    CAST(38 + (event_id * 71) % 729 AS DOUBLE) / 10 AS torque_nm,
    CAST((event_id * 13) % 254 AS INT) AS tool_wear_min,
    CAST((event_id * 7) % cap AS DOUBLE) / 1000 AS prob_twf,
    CAST((event_id * 11) % cap AS DOUBLE) / 1000 AS prob_hdf,
    CAST((event_id * 17) % cap AS DOUBLE) / 1000 AS prob_pwf,
    CAST((event_id * 19) % cap AS DOUBLE) / 1000 AS prob_osf,
    CAST((event_id * 23) % cap AS DOUBLE) / 1000 AS prob_rnf,
    CAST(CASE WHEN event_type = 'error' AND event_id % 8 = 0 THEN 1 ELSE 0 END AS INT) AS machine_failure
  FROM b),
r AS (SELECT *, greatest(prob_twf, prob_hdf, prob_pwf, prob_osf, prob_rnf) AS anomaly_score FROM p)
SELECT *, CAST(CASE WHEN anomaly_score >= 0.5e0 THEN 1 ELSE 0 END AS INT) AS predicted_failure FROM r
"""

# Readings with one label per failure mode; the random mode has a single case.
CASES = """
SELECT *,
  CAST(CASE WHEN prob_twf >= 0.2e0 AND reading_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS twf,
  CAST(CASE WHEN prob_hdf >= 0.25e0 AND reading_id % 7 <> 0 THEN 1 ELSE 0 END AS INT) AS hdf,
  CAST(CASE WHEN prob_pwf <= 0.1e0 AND reading_id % 11 = 0 THEN 1 ELSE 0 END AS INT) AS pwf,
  CAST(CASE WHEN reading_id % 50 = 0 THEN 1 ELSE 0 END AS INT) AS osf,
  CAST(CASE WHEN reading_id = 77 THEN 1 ELSE 0 END AS INT) AS rnf
FROM readings
"""

# Readings somewhat wider than the ranges of normal operation, so that limits are breached.
STRESSED = """
SELECT reading_id, event_ts, equipment_id, node_id, node_name, product_type,
  CAST(2930 + (reading_id * 37) % 121 AS DOUBLE) / 10 AS air_temp_k,
  CAST(3030 + (reading_id * 53) % 111 AS DOUBLE) / 10 AS process_temp_k,
  CAST(1068 + (reading_id * 101) % 1919 AS INT) AS rpm,
  CAST(8 + (reading_id * 71) % 829 AS DOUBLE) / 10 AS torque_nm,
  CAST((reading_id * 13) % 264 AS INT) AS tool_wear_min,
  prob_twf, prob_hdf, prob_pwf, prob_osf, prob_rnf, machine_failure, anomaly_score, predicted_failure
FROM readings
"""

ALERTS = """
SELECT reading_id AS alert_id, equipment_id, node_id, node_name, event_ts,
  CASE WHEN anomaly_score <= 0 THEN 'MULTIPLE'
       WHEN prob_twf = anomaly_score THEN 'TWF' WHEN prob_hdf = anomaly_score THEN 'HDF'
       WHEN prob_pwf = anomaly_score THEN 'PWF' WHEN prob_osf = anomaly_score THEN 'OSF' ELSE 'RNF' END AS failure_mode,
  anomaly_score AS probability,
  CASE WHEN anomaly_score >= 0.9e0 THEN 'critical' WHEN anomaly_score >= 0.8e0 THEN 'high' ELSE 'medium' END AS severity,
  anomaly_score, air_temp_k, process_temp_k, rpm, torque_nm, tool_wear_min,
  CAST(CASE WHEN reading_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS resolved
FROM readings WHERE anomaly_score >= 0.65e0
"""

# Alerts of every other node; those of the rest have been seen to.
QUIET_ALERTS = """
SELECT alert_id, node_id, severity, anomaly_score,
  CAST(CASE WHEN node_id < 'node-009' THEN 1 ELSE resolved END AS INT) AS resolved FROM alerts
"""

NOMINALS = """
WITH g AS (
  SELECT p_partkey, p_retailprice, 'MT' AS regime, 1.0e0 AS k FROM part
  UNION ALL SELECT p_partkey, p_retailprice, 'BL1', 0.95e0 FROM part
  UNION ALL SELECT p_partkey, p_retailprice, 'BL2', 0.9e0 FROM part)
SELECT 'T-' || CAST(p_partkey AS STRING) AS tag, regime,
  CASE WHEN p_partkey % 97 = 0 THEN 0.0e0 ELSE p_retailprice * k END AS nominal_value
FROM g
"""

PROCESS_RAW = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS reading_id,
  'ug-' || CAST(l_suppkey % 2 AS STRING) AS equipment_id,
  'T-' || CAST(l_partkey AS STRING) AS tag,
  CASE l_returnflag WHEN 'A' THEN 'MT' WHEN 'N' THEN 'BL1' ELSE 'BL2' END AS regime,
  CAST(80 + (l_orderkey * 17 + l_linenumber * 7) % 41 AS INT) AS value_pct,
  l_shipdate AS event_ts
FROM lineitem
"""

PROCESS_MEASURED = """
SELECT r.reading_id, r.equipment_id, r.tag, r.regime, r.value_pct, r.event_ts,
  n.nominal_value * r.value_pct / 100e0 AS value
FROM process_raw r JOIN nominals n ON r.tag = n.tag AND r.regime = n.regime
"""

PROCESS_READINGS = """
SELECT m.reading_id, m.equipment_id, m.tag, 'Fluid ' || m.regime AS variable, 'Flow' AS variable_medicion,
  m.value, 'm3/h' AS unit, m.regime, n.nominal_value,
  CASE WHEN n.nominal_value = 0 THEN 0e0 ELSE CAST(m.value_pct - 100 AS DOUBLE) END AS deviation_pct,
  CAST(CASE WHEN m.value_pct < 84 OR m.value_pct > 116 THEN 1 ELSE 0 END AS INT) AS is_anomaly,
  'Well' AS desde, 'Tank' AS hasta, replace(CAST(m.event_ts AS STRING), ' ', 'T') || 'Z' AS timestamp
FROM process_measured m JOIN nominals n ON m.tag = n.tag AND m.regime = n.regime
"""

SCENES = """
SELECT vec_id AS scene_no, CASE WHEN label % 2 = 0 THEN 'Fire' ELSE 'No Fire' END AS category,
  embedding AS px FROM embeddings
"""

MODEL_OUTPUTS = """
SELECT event_id AS sample_id, CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS run,
  event_type AS truth_type, CAST(event_id % 7 AS INT) AS truth_k,
  CASE event_id % 5
    WHEN 0 THEN repeat(chr(96), 3) || 'json' || chr(10) || '{"t": "' || event_type || '", "k": ' || CAST(event_id % 7 AS STRING) || '}' || chr(10) || repeat(chr(96), 3)
    WHEN 1 THEN '{"t": "view", "k": ' || CAST(event_id % 7 AS STRING) || '}'
    WHEN 2 THEN 'Answer: {"t": "' || event_type || '"} done'
    WHEN 3 THEN '{"t": "' || event_type || '", "k": '
    ELSE '' END AS raw,
  CAST((event_id * 29) % 500 AS DOUBLE) / 100 AS latency_s
FROM events
"""

# Training logs of many runs: one run per user, steps in order of the event number.
EPOCHS = """
SELECT user_id AS run_id, event_id AS epoch,
  CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS f1_macro,
  CASE WHEN event_type = 'view' THEN NULL ELSE CAST(1 + (event_id * 31) % 997 AS DOUBLE) / 1000 END AS loss,
  CASE WHEN event_type = 'view' THEN CAST(1 + (event_id * 17) % 499 AS DOUBLE) / 1000 END AS eval_loss,
  CAST(1 + (event_id * 13) % 777 AS DOUBLE) / 100 AS grad_norm
FROM events
"""

VIEWS = {
    "readings": READINGS,
    "cases": CASES,
    "stressed": STRESSED,
    "alerts": ALERTS,
    "quiet_alerts": QUIET_ALERTS,
    "nominals": NOMINALS,
    "process_raw": PROCESS_RAW,
    "process_measured": PROCESS_MEASURED,
    "process_readings": PROCESS_READINGS,
    "scenes": SCENES,
    "model_outputs": MODEL_OUTPUTS,
    "epochs": EPOCHS,
}
NEEDS = {
    "cases": ("readings",),
    "stressed": ("readings",),
    "alerts": ("readings",),
    "quiet_alerts": ("readings", "alerts"),
    "process_measured": ("process_raw", "nominals"),
    "process_readings": ("process_raw", "nominals", "process_measured"),
}
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _with_needs(names: Sequence[str]) -> list[str]:
    chain: list[str] = []
    for name in names:
        for view in (*NEEDS.get(name, ()), name):
            if view not in chain:
                chain.append(view)
    return chain


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a test table, as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    words = set(re.findall(r"\w+", text))
    for base in TABLES:
        if base in words:
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    for need in NEEDS.get(name, ()):
        view(spark, sf_dir, need).createOrReplaceTempView(need)
    return spark.sql(text)


def with_views(names: Sequence[str], body: str) -> str:
    """The check query with its views in front; a body that starts with a comma adds its own."""
    parts = ", ".join(f"{name} AS ({VIEWS[name]})" for name in _with_needs(names) if name in VIEWS)
    body = body.strip()
    if not parts:
        return f"WITH {body[1:]}" if body.startswith(",") else body
    return f"WITH {parts} {body}"


def register(name: str, views: Sequence[str], sql: str | None = None):
    """Register a function of the named views as a query, with its check query."""

    def keep(build: Callable[..., DataFrame]):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(*[view(spark, sf_dir, v) for v in views])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return build

    return keep


def register_source(name: str, views: Sequence[str], sql: str | None = None):
    """Register a function of (spark, sf_dir); the views serve its check query."""

    def keep(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return build

    return keep


def rounded(expression: str, digits: int) -> str:
    """SQL twin of `report_round`."""
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"
