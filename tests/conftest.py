import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tagloom.session import build_session

    session = build_session(
        "tagloom-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Apply a column function to one value per row of a string column."""

    def apply(values, function, schema="v string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
        out = rows.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
        return [_plain(row["r"]) for row in out]

    return apply


def _plain(value):
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return tuple(value) if hasattr(value, "asDict") else value
