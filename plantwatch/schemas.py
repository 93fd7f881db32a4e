"""Declared schemas: what the gateways send, and the tables built from it."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "TIMESTAMP": T.TimestampType(),
}


def _columns(text: str) -> T.StructType:
    """Schema from "name TYPE, ..."; unlike the parser of Spark it needs no session."""
    pairs = [column.strip().strip("`").rsplit(" ", 1) for column in text.split(",")]
    return T.StructType([T.StructField(name.rstrip("`"), _TYPES[kind]) for name, kind in pairs])


# What a gateway sends per reading. It carries no time; that comes from the landing path.
READING_PAYLOAD = _columns(
    """reading_id BIGINT, equipment_id STRING, node_id STRING, node_name STRING, equipment_type STRING,
    product_type STRING, air_temp_k DOUBLE, process_temp_k DOUBLE, rpm INT, torque_nm DOUBLE, tool_wear_min INT,
    anomaly_score DOUBLE, predicted_failure INT, machine_failure INT, twf INT, hdf INT, pwf INT, osf INT, rnf INT,
    prob_twf DOUBLE, prob_hdf DOUBLE, prob_pwf DOUBLE, prob_osf DOUBLE, prob_rnf DOUBLE"""
)

ALERT_PAYLOAD = _columns(
    """equipment_id STRING, node_id STRING, node_name STRING, failure_mode STRING, probability DOUBLE,
    severity STRING, anomaly_score DOUBLE, air_temp_k DOUBLE, process_temp_k DOUBLE, rpm INT, torque_nm DOUBLE,
    tool_wear_min INT, resolved INT"""
)

PROCESS_PAYLOAD = _columns(
    """reading_id STRING, equipment_id STRING, tag STRING, variable STRING, variable_medicion STRING, value DOUBLE,
    unit STRING, regime STRING, nominal_value DOUBLE, deviation_pct DOUBLE, is_anomaly INT, desde STRING,
    hasta STRING, timestamp STRING"""
)

PAYLOADS = {
    "sensor_readings": READING_PAYLOAD,
    "alerts": ALERT_PAYLOAD,
    "process_readings": PROCESS_PAYLOAD,
}

# Delimited tables, in the order of their columns.
READING_TABLE = _columns(
    """reading_id BIGINT, equipment_id STRING, equipment_type STRING, timestamp TIMESTAMP, air_temp_k DOUBLE,
    process_temp_k DOUBLE, rpm INT, torque_nm DOUBLE, tool_wear_min INT, product_type STRING, anomaly_score DOUBLE,
    predicted_failure INT, machine_failure INT, twf INT, hdf INT, pwf INT, osf INT, rnf INT, prob_twf DOUBLE,
    prob_hdf DOUBLE, prob_pwf DOUBLE, prob_osf DOUBLE, prob_rnf DOUBLE"""
)

ALERT_TABLE = _columns(
    """alert_id STRING, equipment_id STRING, timestamp TIMESTAMP, failure_mode STRING, probability DOUBLE,
    severity STRING, anomaly_score DOUBLE, air_temp_k DOUBLE, process_temp_k DOUBLE, rpm INT, torque_nm DOUBLE,
    tool_wear_min INT, resolved INT, resolved_at TIMESTAMP"""
)

# Tables of the lake: the payload with its event time, partitioned by equipment and day.
EVENT_TIME = "event_ts"
EVENT_DAY = "event_date"
EQUIPMENT = "equipment_id"
BATCH = "batch_id"


def lake_schema(table: str) -> T.StructType:
    payload = PAYLOADS[table]
    extra = [T.StructField("alert_id", T.StringType())] if table == "alerts" else []
    if table == "alerts":
        extra.append(T.StructField("reading_id", T.LongType()))
        extra.append(T.StructField("resolved_at", T.TimestampType()))
    return T.StructType([*payload.fields, *extra, T.StructField(EVENT_TIME, T.TimestampType())])


# Machine table with its named header, and the predictions exported from it.
AI4I = _columns(
    """UDI BIGINT, `Product ID` STRING, Type STRING, `Air temperature [K]` DOUBLE, `Process temperature [K]` DOUBLE,
    `Rotational speed [rpm]` INT, `Torque [Nm]` DOUBLE, `Tool wear [min]` INT, `Machine failure` INT, TWF INT,
    HDF INT, PWF INT, OSF INT, RNF INT"""
)
AI4I_NAMES = {
    "Type": "product_type",
    "Air temperature [K]": "air_temp_k",
    "Process temperature [K]": "process_temp_k",
    "Rotational speed [rpm]": "rpm",
    "Torque [Nm]": "torque_nm",
    "Tool wear [min]": "tool_wear_min",
    "Machine failure": "machine_failure",
}

# Predictions exported per row of the machine table; the score is that of the isolation forest.
PREDICTIONS = _columns(
    """UDI BIGINT, `Product ID` STRING, Type STRING, `Machine failure` INT, TWF INT, HDF INT, PWF INT, OSF INT,
    RNF INT, anomaly_score DOUBLE, predicted_failure INT"""
)
PREDICTION_NAMES = {
    "Type": "product_type",
    "Machine failure": "machine_failure",
    "anomaly_score": "iforest_score",
}

SCENE_TABLE = _columns(
    """scene_id STRING, category STRING, rgb_path STRING, thermal_path STRING, thermal_tiff_path STRING,
    label_json STRING, split STRING"""
)
