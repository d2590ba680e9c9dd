"""Written intermediate tables and joins against small key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.session import scratch_path, whole_texts  # noqa: F401 - the operators take both from here


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, kept through lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fingerprint(text: Column) -> Column:
    """With the id, tells rows apart whose ids are repeated or NULL."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())
