"""Session, shared scratch space and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Largest table, as text, that is copied to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# Largest table, in rows of a known short shape, that may be copied without measuring it.
BROADCAST_ROWS = 100_000

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
WHOLE_TEXTS = 1000


def whole_texts(spark: SparkSession) -> None:
    """Smaller Arrow batches for rows that hold whole texts.

    The default of 10,000 rows suits short rows; with long texts a batch of it takes tens of
    megabytes several times over in every task. A setting of the session's own is left alone.
    """
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(WHOLE_TEXTS))


def build_session(app_name: str = "tagloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this package relies on; a running session is reused."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # A model may repeat a key in its JSON; the last value counts.
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder: on a cluster a machine-local path would be lost with its node.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="tagloom-")
        sc.setCheckpointDir(configured)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; a run never writes over another run's files."""
    return os.path.join(shared_dir(spark), f"tagloom-{uuid.uuid4().hex}", name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the loop survives lost executors and plans stay short."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A table put down as compressed columns, for large ones that are read more than once.

    A checkpoint holds rows as they lie in memory, several times the bytes.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its measured size allows it.

    Vocabularies and score tables are small most of the time, and broadcasting them keeps the far
    larger side of the join where it is. Beyond the limit the table is returned as it is and the
    join shuffles, where adaptive execution splits keys that hold too many rows.
    """
    width = F.length(F.to_json(F.struct("*"))).cast("long")
    size = table.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def bounded_side(table: DataFrame, max_rows: int) -> DataFrame:
    """A table that cannot have more than ``max_rows`` rows, broadcast if that is few enough."""
    return F.broadcast(table) if max_rows <= BROADCAST_ROWS else table
