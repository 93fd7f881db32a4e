"""Small tables of known size, which Spark may broadcast."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SMALL_ROWS = 50_000


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType) -> DataFrame:
    """Table of flat driver-side rows. Its size is known to the planner."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if not rows:
        return spark.createDataFrame([], schema)
    columns = {field.name: pa.array([row[i] for row in rows]) for i, field in enumerate(schema.fields)}
    return spark.createDataFrame(pa.table(columns), schema)


def small_rows(df: DataFrame, max_rows: int = SMALL_ROWS) -> pa.Table | None:
    """The rows of `df` on the driver, or None when there are more than `max_rows`.

    Never more than `max_rows` + 1 rows reach the driver.
    """
    rows = df.limit(max_rows + 1).toArrow()
    return rows if rows.num_rows <= max_rows else None


def measured(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Run `df` when it is small and hold its rows; leave it as it is when it is not.

    Use it for flat statistics whose size is expected, but not certain, to be small: the planner
    then knows the size, and joins a larger result by shuffle.
    """
    rows = small_rows(df, max_rows)
    return df if rows is None else df.sparkSession.createDataFrame(rows, df.schema)
