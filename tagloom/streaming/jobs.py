"""Structured Streaming jobs: tag answers as they arrive, count tags per window, promote tags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagloom.functions.responses import names_of, tags_objects
from tagloom.operators.normalize import record_cleaner

_TAGS_HELD = 200_000  # that a task adds up before it sends them


def run_tagging(
    spark: SparkSession,
    input_path: str,
    schema: str | T.StructType,
    mapping: DataFrame,
    output_path: str,
    checkpoint_path: str,
    *,
    parse: Callable[[Column], Column] = lambda raw: names_of(tags_objects(raw)),
) -> DataFrame:
    """Parse and map the answers in files that are new since the last run, then stop.

    A record is one row, so every micro-batch is complete by itself and no state is kept. Its
    output folder is named by the batch, so a batch that is run again after a failure replaces
    its own rows and nothing is written twice.
    """

    answers = spark.readStream.schema(schema).parquet(input_path)
    return _tag(answers, mapping, output_path, checkpoint_path, parse)


def run_tagging_once(
    spark: SparkSession,
    input_path: str,
    schema: str | T.StructType,
    mapping: DataFrame,
    output_path: str,
    checkpoint_path: str,
    *,
    ts: str = "ts",
    within: str = "1 day",
    files_at_once: int | None = None,
    parse: Callable[[Column], Column] = lambda raw: names_of(tags_objects(raw)),
) -> DataFrame:
    """``run_tagging`` where files may repeat samples: the first answer of a sample is stored.

    The ids seen are keyed state, kept with the query's progress, so a sample that comes again in
    another micro-batch or after a restart is left out. An id is forgotten once the watermark has
    passed its answer's time by ``within``: the state holds the samples of that span, however long the
    stream runs, and a sample that comes back later still is stored anew. Answers without an id or
    a time are left out, as are those not after the watermark, which begins in 1970.
    """
    read = spark.readStream.schema(schema)
    if files_at_once:
        read = read.option("maxFilesPerTrigger", files_at_once)
    answers = read.parquet(input_path).withWatermark(ts, within)
    usable = answers.where(F.col("sample_id").isNotNull() & F.col(ts).isNotNull())
    known = usable.dropDuplicatesWithinWatermark(["sample_id"])
    return _tag(known, mapping, output_path, checkpoint_path, parse)


def _tag(
    answers: DataFrame,
    mapping: DataFrame,
    output_path: str,
    checkpoint_path: str,
    parse: Callable[[Column], Column],
) -> DataFrame:
    clean = record_cleaner(mapping)

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = batch.select("sample_id", parse(F.col("raw_response")).alias("tags"))
        clean(parsed).write.mode("overwrite").parquet(f"{output_path}/batch_id={batch_id}")

    query = (
        answers.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return answers.sparkSession.read.schema("sample_id long, tags string, batch_id int").parquet(
        output_path
    )


def windowed_tag_counts(
    tags: DataFrame, *, ts: str = "ts", tag: str = "tag", window: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """Tag counts per tumbling window; a window is final once the watermark passed its end."""
    return (
        tags.withWatermark(ts, late)
        .groupBy(F.window(ts, window).alias("w"), F.col(tag).alias("tag"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tag", "n")
    )


def running_vocabulary(tags: DataFrame, min_count: int, *, tag: str = "tag") -> DataFrame:
    """``(tag, n)`` of a stream of tags: each tag once, when its count first reaches ``min_count``.

    A task first adds up the tags it has read, so a tag that many records share comes to its state
    as one row for each task and micro-batch. The state is a count by tag, until it is promoted; from
    then on only the fact. ``n`` is the count at that time. NULL tags don't count.
    """

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = {}
        for frame in frames:
            for name, n in frame["tag"].value_counts().items():
                total[name] = total.get(name, 0) + int(n)
            if len(total) > _TAGS_HELD:
                yield pd.DataFrame({"tag": list(total), "n": list(total.values())})
                total = {}
        if total:
            yield pd.DataFrame({"tag": list(total), "n": list(total.values())})

    def promote(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        if before is None:  # promoted earlier
            return
        n = before + sum(int(frame["n"].sum()) for frame in frames)
        state.update((None if n >= min_count else n,))
        if n >= min_count:
            yield pd.DataFrame({"tag": [key[0]], "n": [n]})

    named = tags.select(F.col(tag).cast("string").alias("tag")).where(F.col("tag").isNotNull())
    shape = "tag string, n long"
    return (
        named.mapInPandas(add_up, shape)
        .groupBy("tag")
        .applyInPandasWithState(promote, shape, "n long", "append", GroupStateTimeout.NoTimeout)
    )


def run_to_files(stream: DataFrame, output_path: str, checkpoint_path: str) -> DataFrame:
    """Process everything available, append it to files and return the table written."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output_path)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(output_path)
