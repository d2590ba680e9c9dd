"""Batch inference as a ``mapInPandas`` stage with a pluggable model."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tagloom.session import whole_texts

# Executors need not have this package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules["tagloom"])

Model = Callable[[list[str]], list[str]]
FAILED = "Error"
CHUNK = "inference_chunk"


def _answers(model: Model, texts: list[str], per_row: bool) -> list[tuple[str, str | None]]:
    """Answers with an error text each; a failing batch never stops the job.

    Too few or too many answers can't be told apart by text, so they fail the batch; an answer
    that is no text fails it as well.
    """
    try:
        answers = list(model(texts))
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers to {len(texts)} texts")
        if odd := [a for a in answers if a is not None and not isinstance(a, str)]:
            raise TypeError(f"an answer of type {type(odd[0]).__name__}")
        return [(answer, None) for answer in answers]
    except Exception as error:  # noqa: BLE001 - whatever the model raises is recorded
        if per_row and len(texts) > 1:
            return [_answers(model, [text], False)[0] for text in texts]
        return [(FAILED, str(error))] * len(texts)


def _batches(texts: list[str | None], rows: int, budget: int | None) -> Iterator[list[int]]:
    """Places of the texts of each batch."""
    if budget is None:
        yield from (list(range(at, min(at + rows, len(texts)))) for at in range(0, len(texts), rows))
        return
    length = [len(x) if isinstance(x, str) else 0 for x in texts]
    batch: list[int] = []
    for i in sorted(range(len(texts)), key=lambda i: (length[i], i)):
        # Sorted, so this text would be the longest of the batch.
        if batch and (len(batch) == rows or length[i] * (len(batch) + 1) > budget):
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def batch_infer(
    df: DataFrame,
    model_factory: Callable[[], Model],
    *,
    text: str = "full_input",
    batch_size: int = 64,
    retry_rows: bool = False,
    partitions: int | None = None,
    budget: int | None = None,
) -> DataFrame:
    """Adds ``raw_response`` and ``error``, keeping all columns.

    ``model_factory`` runs once per task, so a model is loaded once for many batches. A batch
    that fails is marked as a whole, or row by row with ``retry_rows``. ``partitions`` spreads
    the rows anew when the stage is much heavier than reading its input.

    A model pads the texts of a batch to the longest one. With a ``budget``, the rows a task holds are
    batched by length: a batch is as many rows (at most ``batch_size``) as fit the budget at the length
    of its longest text, in characters; a longer text goes alone. Rows come back in their order. A task
    holds one Arrow batch of rows, 1,000 where the session has Spark's default.
    """
    schema = T.StructType(
        df.schema.fields
        + [T.StructField("raw_response", T.StringType()), T.StructField("error", T.StringType())]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            found: list[tuple[str | None, str | None]] = [(None, None)] * len(frame)
            texts = frame[text].tolist()
            for places in _batches(texts, batch_size, budget):
                if model is None:
                    model = model_factory()
                for i, answer in zip(places, _answers(model, [texts[i] for i in places], retry_rows)):
                    found[i] = answer
            yield frame.assign(
                raw_response=[answer for answer, _ in found], error=[error for _, error in found]
            )

    whole_texts(df.sparkSession)
    spread = df if partitions is None else df.repartition(partitions)
    return spread.mapInPandas(run, schema)


def infer_in_chunks(
    df: DataFrame,
    model_factory: Callable[[], Model],
    path: str,
    *,
    key: str,
    chunks: int = 64,
    at_once: int = 8,
    most: int | None = None,
    **inference: object,
) -> DataFrame:
    """``batch_infer`` whose answers are stored chunk by chunk, so that a run can be taken up again.

    Below ``path`` lie three tables. ``asked`` holds the rows, dealt into ``chunks`` by the hash of
    ``key`` when the first run starts; later runs read it and take no notice of ``df``. ``answers``
    holds a folder for each chunk. ``chunks`` is the record of chunks whose answers are complete: a row
    is added once they are written, and only chunks with a row are returned. A run asks the model for
    the chunks without one, ``at_once`` in a job, and at most ``most`` of them. What a run that died had
    written of a chunk is written over; a chunk on record is never asked again.

    All rows of one key lie in one chunk; a chunk is read by as many tasks as its files take, so a key
    that a third of the rows share makes a long chunk, not a long task. ``path`` is for one run at a time.
    """
    spark = df.sparkSession
    asked_path, answers_path, record_path = (f"{path}/{x}" for x in ("asked", "answers", "chunks"))
    chunk = F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias(CHUNK)
    if not _complete(spark, asked_path):
        df.select("*", chunk).write.mode("overwrite").partitionBy(CHUNK).parquet(asked_path)
    asked = spark.read.schema(_plus(df.schema).add(CHUNK, T.IntegerType())).parquet(asked_path)
    record_schema = f"{CHUNK} int, n long, finished timestamp"

    def recorded() -> dict[int, int]:
        """Rows of each chunk on record; a bounded number of chunks."""
        if not _complete(spark, record_path):
            return {}
        rows = spark.read.schema(record_schema).parquet(record_path).collect()
        return {r[CHUNK]: r["n"] for r in rows}

    known = recorded()
    missing = [c for c in range(chunks) if c not in known][:most]
    for at in range(0, len(missing), at_once):
        some = missing[at : at + at_once]
        answered = batch_infer(asked.where(F.col(CHUNK).isin(some)), model_factory, **inference)
        answered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            CHUNK
        ).parquet(answers_path)
        counts = (
            spark.read.schema(answered.schema).parquet(answers_path)
            .where(F.col(CHUNK).isin(some)).groupBy(CHUNK).agg(F.count("*").alias("n"))
        )
        done = spark.createDataFrame([(c,) for c in some], f"{CHUNK} int").join(counts, CHUNK, "left")
        done.select(CHUNK, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.current_timestamp().alias("finished")).coalesce(
            1
        ).write.mode("append").parquet(record_path)
    shape = _plus(df.schema).add("raw_response", T.StringType()).add("error", T.StringType()).add(CHUNK, T.IntegerType())
    filled = sorted(c for c, n in recorded().items() if n)
    if not filled:
        return spark.createDataFrame([], shape).drop(CHUNK)
    answers = spark.read.schema(shape).parquet(answers_path)
    return answers.where(F.col(CHUNK).isin(filled)).drop(CHUNK)


def _plus(schema: T.StructType) -> T.StructType:
    """A copy to add fields to."""
    return T.StructType(list(schema.fields))


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has ever ended."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
