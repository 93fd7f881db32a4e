"""What to do about a failure mode: names, work steps and spare parts, as small rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.functions.rules import MODES, PROBABILITIES
from plantwatch.local import local_table

SIMILAR = 0.05

MODE_NAMES = {
    "TWF": "tool wear failure",
    "HDF": "heat dissipation failure",
    "PWF": "power failure",
    "OSF": "overstrain failure",
    "RNF": "random failure",
}

# A short plan per mode, for callers without work instructions of their own; it names the readings that show the mode.
WORK_STEPS = (
    ("TWF", 1, "compare tool_wear_min with the limit of the tool"),
    ("TWF", 2, "change the tool and reset its counter"),
    ("HDF", 1, "compare process_temp_k with air_temp_k at low rpm"),
    ("HDF", 2, "restore the cooling"),
    ("PWF", 1, "compare torque_nm times rpm with the rated power"),
    ("PWF", 2, "restore the supply"),
    ("OSF", 1, "compare tool_wear_min times torque_nm with the strain limit"),
    ("OSF", 2, "reduce the load"),
    ("RNF", 1, "repeat the measurement"),
)
SPARE_PARTS = (("TWF", "tool"), ("HDF", "fan"), ("PWF", "fuse"), ("OSF", "clutch"), ("RNF", ""))


def mode_table(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(MODE_NAMES.items()), "failure_mode string, mode_name string")


def step_table(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(WORK_STEPS), "failure_mode string, step_no int, step string")


def parts_table(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(SPARE_PARTS), "failure_mode string, parts string")


def mode_label(df: DataFrame, mode: str = "failure_mode", name: str = "mode_name") -> DataFrame:
    """Add the name of a failure mode in plain words; a mode without a name stays NULL."""
    names = mode_table(df.sparkSession).select(F.col("failure_mode").alias(mode), F.col("mode_name").alias(name))
    return df.join(names, mode, "left")


def likely_modes(averages: dict[str, Column], dominant: Column, tolerance: float = SIMILAR) -> Column:
    """Array of the dominant mode, and of the runner-up when its probability is close."""
    top = F.greatest(*averages.values())
    close = F.array_compact(
        F.array(*[F.when((top - p <= tolerance) & (F.lit(m) != dominant), F.struct((-p).alias("p"), F.lit(MODES.index(m)).alias("o"), F.lit(m).alias("m"))) for m, p in averages.items()])
    )
    second = F.get(F.array_sort(close), F.lit(0))["m"]
    return F.array_compact(F.array(dominant, second))


def attach_interventions(
    diagnosed: DataFrame, steps: DataFrame | None = None, parts: DataFrame | None = None, tolerance: float = SIMILAR
) -> DataFrame:
    """One row per work step of the dominant mode, and of a second mode about as likely.

    `steps` (failure_mode, step_no, step) and `parts` (failure_mode, parts) are the caller's work instructions; without them a
    short plan of this library stands in. Adds `mode_rank` (1 for the dominant mode), `failure_mode`, `step_no`, `step`
    and `parts`, which is NULL for a mode without any.
    """
    spark = diagnosed.sparkSession
    steps = step_table(spark) if steps is None else steps
    parts = parts_table(spark) if parts is None else parts
    averages = {m: F.col(f"avg_{p}") for m, p in zip(MODES, PROBABILITIES)}
    per_mode = diagnosed.select(
        "*", F.posexplode(likely_modes(averages, F.col("dominant_failure_mode"), tolerance)).alias("_i", "failure_mode")
    )
    return (
        per_mode.withColumn("mode_rank", F.col("_i") + 1)
        .drop("_i")
        .join(steps.select("failure_mode", "step_no", "step"), "failure_mode")
        .join(parts.select("failure_mode", "parts"), "failure_mode", "left")
    )
