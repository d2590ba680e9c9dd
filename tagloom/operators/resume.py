"""Restartable work: what is left to do, and appending results once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a result yet."""
    return items.join(done.select(key), key, "left_anti")


def append_once(results: DataFrame, path: str, key: str) -> DataFrame:
    """Append the results whose key is not stored yet and return the stored table.

    Running the same step twice adds nothing, and of several results with one key one is stored.
    """
    spark = results.sparkSession
    single = results.dropDuplicates([key])
    try:
        stored = spark.read.schema(results.schema).parquet(path)
        single = pending(single, stored, key)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
    single.write.mode("append").parquet(path)
    return spark.read.schema(results.schema).parquet(path)
