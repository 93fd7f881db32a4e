"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(master: str | None = None, app: str = "plantwatch", **settings: str) -> SparkSession:
    """Session with the settings the operators expect; `settings` add to them or override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a temporary one only in local runs."""
    shared = spark.conf.get(CHECKPOINT_SETTING, None)
    context = spark.sparkContext
    if shared:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared)
    elif context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a shared folder before running on a cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plantwatch-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint storage."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """Write the rows to shared storage and go on from there; `options` are those of the files.

    They survive the loss of any executor, are computed once, and come back with known statistics.
    """
    folder = shared_folder(df.sparkSession, "table")
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
