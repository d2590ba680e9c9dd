"""Many files and many whole texts: no single task writes them all, no task holds many at once."""

import os

from pyspark.sql import functions as F

from tagloom.operators import inference as I
from tagloom.sources import records as S
from tagloom.sources import sinks as K


def test_single_texts_are_written_by_many_tasks(spark, tmp_path):
    texts = [f"file {i}\nsecond line of {i}" for i in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    names = os.listdir(K.write_single_texts(rows, f"{tmp_path}/code"))
    parts = [n for n in names if n.startswith("part-")]
    assert len(parts) == 60 and len({n.split("-")[1] for n in parts}) > 8
    assert not [n for n in names if n.endswith(".txt.crc")]
    assert sorted(r["prompt"] for r in S.read_code_files(spark, f"{tmp_path}/code").collect()) == sorted(texts)


def test_single_files_hold_the_bytes_of_their_rows(spark, tmp_path):
    """Nulls, blank and damaged texts; Hadoop would start a process for each local file."""
    texts = [b"", b"\n\n", b"a\xffb and more text", "é".encode(), None, b"same", b"same"]
    rows = spark.createDataFrame([(t,) for t in texts], "v binary").selectExpr("cast(v as string) AS text")
    root = K.write_single_texts(rows, f"file:{tmp_path}/code").removeprefix("file:")
    names = [n for n in os.listdir(root) if n.startswith("part-")]
    assert sorted(open(f"{root}/{n}", "rb").read() for n in names) == sorted((t or b"") + b"\n" for t in texts)
    assert sorted(names) == sorted(os.listdir(root))
    assert S.read_code_files(spark, root).collect() == [("ab and more text",)]
    assert S.read_code_files(spark, K.write_single_texts(rows.limit(0), f"{tmp_path}/none")).collect() == []


def test_a_task_holds_few_texts_at_once(spark):
    def counting():
        return lambda texts: [str(len(texts))] * len(texts)

    rows = spark.range(0, 5_000, 1, 1).select(F.lit("text").alias("full_input"))
    sizes = I.batch_infer(rows, counting, batch_size=1 << 20).select("raw_response").distinct().collect()
    assert max(int(r["raw_response"]) for r in sizes) <= 1_000
