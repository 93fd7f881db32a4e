"""Where intermediate tables go, and tables of known size."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from plantwatch import local, session


def test_lineage_is_cut_into_the_checkpoint_folder(spark):
    df = spark.range(10).select("id", F.struct("id").alias("s"), F.lit(None).cast("string").alias("n"))
    kept = session.cut_lineage(df)
    assert kept.dtypes == df.dtypes
    assert kept.exceptAll(df).count() == 0
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert all(f.removeprefix("file://").startswith(folder) for f in kept.inputFiles())
    assert os.path.isdir(folder)


def test_local_tables_have_a_known_size(spark):
    table = local.local_table(spark, [("a", 1, None), ("b", None, 2.0)], "k string, n int, x double")
    assert "LocalTableScan" in table._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in table.collect()] == [("a", 1, None), ("b", None, 2.0)]
    assert local.local_table(spark, [], "k string").count() == 0


def test_measured_keeps_values_and_gives_up_when_large(spark):
    df = spark.range(100).select("id", F.lit(datetime(2024, 1, 1, 2, 3)).alias("t"), F.lit(None).cast("int").alias("n"))
    small = local.measured(df, 100)
    assert "LocalTableScan" in small._jdf.queryExecution().executedPlan().toString()
    assert small.exceptAll(df).count() == 0 and small.schema.names == df.schema.names
    assert local.measured(df, 99) is df
    assert local.measured(df.limit(0), 5).count() == 0
