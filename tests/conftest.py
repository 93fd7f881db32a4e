import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plantwatch.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate Column expressions over one row of named values."""

    def evaluate(row: dict, schema: str, *columns):
        df = spark.createDataFrame([tuple(row.values())], schema)
        result = df.select(*columns).first()
        return result[0] if len(columns) == 1 else tuple(result)

    return evaluate
