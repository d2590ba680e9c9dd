"""Extraction, prompts, sources, sinks, sampling, inference and streams."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F, types as T

from tagloom.functions import prompts as P
from tagloom.functions.text import strip, word_count
from tagloom.operators import extract as E
from tagloom.operators import inference as I
from tagloom.operators import resume, sampling as L
from tagloom.sources import records as S
from tagloom.sources import sinks as K
from tagloom.streaming import jobs
from tagloom.functions import responses as J


def values(df, name="prompt"):
    return [r[name] for r in df.collect()]


def test_strip_is_unicode(column):
    assert column(["　 a\x0b\x1c", "\x85 ", "b"], strip) == ["a", "", "b"]
    assert column(["", " a  b\tc ", None], word_count) == [0, 3, 0]


def test_instruction_prompts(spark):
    rows = spark.createDataFrame([(" do ", " x "), ("do", "  "), (" ", "x"), (None, "x"), ("do", None)], "i string, c string")
    assert values(E.instruction_prompts(rows, "i", "c")) == ["do\n\nx", "do", "do"]
    assert values(E.field_prompts(rows, "i", with_tags=True), "tags") == [[], [], []]


def test_turns_of_records(spark):
    row = spark.createDataFrame(
        [([("human", " a "), ("gpt", "x"), ("human", "  "), ("human", None), ("human", "b")], ["u ", "v", " ", "w", "z"])],
        "items array<struct<from:string,value:string>>, data array<string>",
    )
    assert values(E.turn_prompts(row, E.human_turns(F.col("items")))) == ["a b"]
    assert values(E.turn_prompts(row, E.human_turns(F.col("items"), keep_blank=True))) == ["a  b"]
    assert values(E.turn_prompts(row, E.even_turns(F.col("data")))) == ["u z"]
    assert values(E.turn_prompts(row, E.even_turns(F.col("data"), keep_blank=True), sep="\n")) == ["u\n\nz"]
    empty = spark.createDataFrame([([],)], "data array<string>")
    assert values(E.turn_prompts(empty, E.even_turns(F.col("data"), keep_blank=True))) == []


def test_long_conversations_keep_order(spark):
    n = 3 * E.TURNS_PER_PIECE + 5
    rows = spark.range(n).select(
        F.lit(1).alias("message_tree_id"), F.col("id").alias("seq"), F.lit("prompter").alias("role"),
        F.concat(F.lit("m'"), "id").alias("text"),
    ).orderBy(F.rand(1))
    assert values(E.message_prompts(rows, sep="'\n")) == ["'\n".join(f"m'{i}" for i in range(n))]


def test_label_tags(spark):
    fields = ", ".join(f"{f} double" for f in E.TOXICITY_FIELDS)
    n = len(E.TOXICITY_FIELDS)
    rows = spark.createDataFrame(
        [("a", 0.4, 0.9, 0.4, 0.3, *[None] * (n - 4)), ("b", *[None] * n), (" ", *[0.9] * n), ("c", *[0.1] * n)],
        f"text string, {fields}",
    )
    got = {r["prompt"]: r["tags"] for r in E.label_tags(rows, "text", {f: F.col(f) for f in E.TOXICITY_FIELDS}).collect()}
    assert got == {"a": ["severe_toxicity", "toxicity", "identity_attack"], "c": []}


def test_add_tags(spark):
    rows = spark.createDataFrame([(["b", "a", "b"],), (None,)], "tags array<string>")
    assert values(E.add_tags(rows, ["a", "z"]), "tags") == [["b", "a", "z"], ["a", "z"]]


def test_first_text(spark):
    rows = spark.createDataFrame(
        [(1, " ", "x", "n"), (2, "", " y ", "n"), (3, None, None, " n "), (4, "", "", " ")],
        "id int, prompt string, text string, note string",
    )
    got = {r["id"]: r["prompt"] for r in E.record_prompts(rows, keep=["id"]).collect()}
    assert got == {1: "x", 2: "y", 3: "n"}
    only = E.record_prompts(rows, candidates=["prompt"], blank_falls_back=False, keep=["id"])
    # A blank prompt is final, an empty or missing one is not.
    assert {r["id"]: r["prompt"] for r in only.collect()} == {2: "y", 3: "n"}


def test_long_context(spark):
    rows = spark.createDataFrame(
        [
            ("/d/ALCE/x.json", "q", "i", None, ["s1", "s2"], "ctx"),
            ("d\\ruler_v1\\x.json", None, "i", None, ["s"], ""),
            ("/d/multi_lexsum/alce/x.json", "q", "i", None, ["s1", "s2"], "ctx"),
            ("/d/msmarco/x.json", "q", "i", None, ["s"], "ctx"),
            ("/d/other/x.json", "q", "i", "w", ["s"], None),
        ],
        "path string, question string, input string, query string, sources array<string>, context string",
    )
    got = values(E.long_context_inputs(rows, "path"), "inference_context")
    assert got == ["q\n\nctx", "i", "s1\n\ns2\n\nctx", "i"]
    forced = E.long_context_inputs(rows, None, input_fields=["query"])
    assert values(forced, "inference_context") == ["w"]


def test_templates_and_truncation(column):
    assert column(["hi {tags}"], lambda c: P.tagging_prompt(c, "query_plain"))[0].endswith("Query: hi {tags} Assistant: ")
    text = "h" * 1200 + "m" * 10 + "t" * 1200
    assert column([text, "s" * 2400], P.truncate_head_tail) == ["h" * 1200 + P.ELISION + "t" * 1200, "s" * 2400]
    words = " ".join("ab"[i % 2] for i in range(3000))
    cut = column([words], P.truncate_head_tail)[0].split(P.ELISION)
    assert [len(part.split()) for part in cut] == [300, 300]
    assert column(["a  b c", "a b"], lambda c: P.truncate_head(c, 2)) == ["a ", "a b"]


def test_training_json_text_is_json(spark):
    tags = [("a\"b", "x\ny"), ("é\\", "")]
    row = spark.createDataFrame([("q", tags)], "p string, t array<struct<tag:string,explanation:string>>")
    text = row.select(P.tags_json(F.col("t"))).first()[0]
    assert text == json.dumps([{"tag": t, "explanation": e} for t, e in tags], ensure_ascii=False)
    done = row.select(P.training_text(F.col("p"), F.transform("t", lambda t: t["tag"]))).first()[0]
    assert done.endswith('Query: q Assistant: a"b, é\\</s>')


def test_tagged_records(spark):
    rows = spark.createDataFrame([("p", "'a, b'"), ("", "a"), ("p", ""), ("p", None)], "prompt string, tags string")
    assert values(S.standardize_tagged(rows), "tags") == [["a", "b"]]
    lists = spark.createDataFrame([("p", ["a"]), ("p", []), (None, ["a"])], "prompt string, tags array<string>")
    assert values(S.standardize_tagged(lists), "tags") == [["a"]]
    texts = spark.createDataFrame([("p", '["a, b", "c"]'), ("p", "d,e")], "prompt string, tags string")
    assert values(S.standardize_tagged(texts, json_lists=True), "tags") == [["a, b", "c"], ["d", "e"]]
    numbers = spark.createDataFrame([("p", 3)], "prompt string, tags int")
    assert S.standardize_tagged(numbers).count() == 0


def test_sources(spark, tmp_path):
    for name in ("a_tagged_total", "b_tagged_total", "other"):
        spark.createDataFrame([(name,)], "v string").write.parquet(f"{tmp_path}/in/{name}")
    got = S.load_with_source(spark, f"{tmp_path}/in", "v string").collect()
    assert {tuple(r) for r in got} == {("a_tagged_total",) * 2, ("b_tagged_total",) * 2}
    assert S.load_with_source(spark, f"{tmp_path}/in", "v string", preferred="none*").count() == 3

    os.makedirs(tmp_path / "json/deep")
    (tmp_path / "json/deep/a.jsonl").write_text('{"v": "x"}\n\nbroken\n{"v": "y"}\n')
    (tmp_path / "json/one.json").write_text('[{"v": "p"},\n {"v": "q"}]')
    (tmp_path / "json/lone.json").write_text('{\n"v": "r"\n}')
    (tmp_path / "json/skip.txt").write_text('{"v": "no"}')
    array = S.read_json_array(spark, f"{tmp_path}/json/*.json", "v string")
    assert sorted(values(array, "v")) == ["p", "q", "r"]
    checked = S.read_json_checked(spark, f"{tmp_path}/json/deep", T.StructType([T.StructField("v", T.StringType())]))
    assert sorted(values(S.good_rows(checked), "v")) == ["x", "y"]
    assert values(S.bad_lines(checked), "line") == ["broken"]
    tree = S.read_json_tree(spark, f"{tmp_path}/json", "v string", pattern="*.jsonl")
    assert tree.filter("v IS NOT NULL").count() == 2

    os.makedirs(tmp_path / "code/sub")
    (tmp_path / "code/a.c").write_bytes(b"  int main() \xff{ }\n")
    (tmp_path / "code/sub/b.cpp").write_text("short")
    (tmp_path / "code/sub/c.py").write_text("print('not read')")
    assert values(S.read_code_files(spark, f"{tmp_path}/code")) == ["int main() { }"]


def test_limit_per_file(spark):
    rows = spark.createDataFrame([("f", i) for i in range(9)] + [("g", 1)], "file string, id int")
    got = L.limit_per_group(rows, 3, "file", "id")
    assert sorted(tuple(r) for r in got.collect()) == [("f", 0), ("f", 1), ("f", 2), ("g", 1)]


def test_output_names(column):
    names = ["x_tagged_total.pkl", "a.b.pkl", "plain", ".hidden"]
    assert column(names, K.clean_name) == ["x_tagged_total_clean", "a.b_clean", "plain_clean", ".hidden_clean"]
    places = column(["/in/a/b/c.v1.jsonl", "/in/d.json"], lambda c: K.mirror_names(c, "/in/"))
    assert places == [("a/b", "c.v1_results"), ("", "d_results")]
    assert K.model_folder("out", "org/model") == "out_org_model"


def test_outputs_per_input_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, "/in/a/x.json"), (2, "/in/a/x.json"), (3, "/in/a/y.json")], "id int, path string")
    K.write_mirrored(rows, "path", "/in", f"{tmp_path}/m")
    assert values(spark.read.parquet(f"{tmp_path}/m/rel_dir=a/base=y_results"), "id") == [3]
    K.write_cleaned(rows.withColumnRenamed("path", "source").replace("/in/a/x.json", "x_tagged_total.pkl"), f"{tmp_path}/c")
    assert sorted(values(spark.read.parquet(f"{tmp_path}/c/file=x_tagged_total_clean"), "id")) == [1, 2]


def test_model_jobs_match_their_schemas(spark):
    from tagloom import schemas
    from tagloom.functions.routes import GENERATION_ERROR
    from tagloom.plans.inference import evaluate_router, tag_prompts

    def echo():
        def answer(texts):
            if any("boom" in t for t in texts):
                raise ValueError("boom")
            return [t + ' [{"tag": "a", "explanation": "b"}]' for t in texts]

        return answer

    def named(schema):
        return [f.name for f in T.StructType.fromDDL(schema).fields]

    prompts = spark.createDataFrame([(1, "hi"), (2, "boom")], schemas.PROMPTS)
    tagged = tag_prompts(prompts, echo, retry_rows=True)
    assert sorted(tagged.columns) == sorted(named(schemas.TAGGING_RESULTS))
    got = {r["sample_id"]: (_tuples(r["parsed_tags"]), r["success"]) for r in tagged.collect()}
    assert got == {1: ([("a", "b")], True), 2: ([("Error", "Processing failed: boom")], False)}

    samples = spark.createDataFrame(
        [(1, "q", "e", ["t"], "m1"), (2, "boom", "e", None, "m1")], schemas.ROUTING_SAMPLES
    )

    def router():
        def answer(texts):
            if any("boom" in t for t in texts):
                raise ValueError("boom")
            return [' {"best_model": "m1" ' for _ in texts]

        return answer

    judged = evaluate_router(samples, F.lit("m1, m2"), router, retry_rows=True)
    assert sorted(c for c in judged.columns if c != "error") == sorted(named(schemas.EVALUATED_SAMPLES))
    got = {r["sample_id"]: (r["prediction"], r["is_correct"]) for r in judged.collect()}
    assert got == {1: ("m1", True), 2: (GENERATION_ERROR, False)}


def _tuples(rows):
    return [tuple(r) for r in rows]


def test_values_at_ranks(spark):
    for ids in (list(range(100)), [7], [-(2**62), -5, 0, 3, 10**15, 2**62], [i * i * 977 for i in range(300)]):
        rows = spark.createDataFrame([(i,) for i in reversed(ids)], "id long")
        ranks = sorted({1, len(ids), (len(ids) + 1) // 2})
        assert L.values_at_ranks(rows, "id", ranks) == [sorted(ids)[r - 1] for r in ranks]


@pytest.mark.parametrize("n, shards", [(10, 3), (2, 5), (12, 4)])
def test_splits(spark, n, shards):
    rows = spark.range(n).select((F.col("id") * 1000).alias("id")).repartition(3)
    got = [r["shard"] for r in L.shard_assign(rows, "id", shards).orderBy("id").collect()]
    chunk = n // shards
    assert got == [min(i // chunk, shards - 1) if chunk else shards - 1 for i in range(n)]
    split = [r["split"] for r in L.prefix_split(rows, "id", 0.25).orderBy("id").collect()]
    assert split.count("train") == int(0.75 * n) and split == sorted(split, reverse=True)


def test_sample_is_reproducible(spark):
    rows = spark.range(500)
    first = sorted(values(L.sample_rows(rows, 50, "id", 3), "id"))
    again = sorted(values(L.sample_rows(rows.repartition(7), 50, "id", 3), "id"))
    assert first == again and len(first) == 50
    assert first != sorted(values(L.sample_rows(rows, 50, "id", 4), "id"))
    assert L.sample_rows(rows.limit(5), 50, "id").count() == 5


def test_inference_isolates_errors(spark):
    def _picky():
        def answer(texts):
            if "bad" in texts:
                raise RuntimeError("cannot")
            return [t.upper() for t in texts]

        return answer

    rows = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(6)], "id int, full_input string").coalesce(1)
    by_row = {r["id"]: (r["raw_response"], r["error"]) for r in I.batch_infer(rows, _picky, batch_size=4, retry_rows=True).collect()}
    assert by_row[3] == (I.FAILED, "cannot") and by_row[0] == ("T0", None)
    by_batch = I.batch_infer(rows, _picky, batch_size=2)
    assert sorted(r["id"] for r in by_batch.collect() if r["error"]) == [2, 3]
    assert I.batch_infer(rows, _picky, partitions=3).count() == 6


def test_batches_by_length(spark):
    seen = []

    def sizes(texts):
        seen.append([len(t) for t in texts])
        return [t[::-1] for t in texts]

    texts = ["x" * n + str(n) for n in (90, 3, 50, 3, 0, 200, 4, 60, 5, 52)]
    rows = [list(b) for b in I._batches(texts, 4, 220)]
    assert sorted(i for b in rows for i in b) == list(range(10)) and max(map(len, rows)) <= 4
    padded = lambda batches: sum(max(len(texts[i]) for i in b) * len(b) for b in batches)
    assert padded(rows) < padded(I._batches(texts, 4, None)) / 1.5  # little padding
    assert all(len(b) == 1 or max(len(texts[i]) for i in b) * len(b) <= 220 for b in rows)
    assert list(I._batches([], 4, 10)) == [] == list(I._batches([], 4, None))
    frame = spark.createDataFrame(list(enumerate([*texts, None])), "id int, full_input string").coalesce(1)
    got = I.batch_infer(frame, lambda: lambda some: [t and t[::-1] for t in some], batch_size=4, budget=220).collect()
    assert [(r["id"], r["raw_response"], r["error"]) for r in got] == [
        (i, t and t[::-1], None) for i, t in enumerate([*texts, None])
    ]


def test_inference_is_taken_up_again(spark, tmp_path):
    """A model that dies midway: the next run asks for the chunks that aren't on record, only them."""
    calls, path = f"{tmp_path}/calls", f"{tmp_path}/work"
    os.mkdir(calls)

    def _model(dies):
        class Dead(BaseException):
            pass

        def load():
            def answer(texts):
                if dies and "t33" in texts:
                    raise Dead("lost")
                for text in texts:
                    with open(f"{calls}/{text}", "a") as f:
                        f.write("x")
                return [t.upper() for t in texts]

            return answer

        return load

    rows = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "id long, full_input string").repartition(3)
    settings = {"key": "id", "chunks": 7, "at_once": 1}
    with pytest.raises(Exception, match="lost"):
        I.infer_in_chunks(rows, _model(True), path, **settings)
    stored = spark.read.parquet(f"{path}/chunks")
    before, first = {r["inference_chunk"]: r["n"] for r in stored.collect()}, set(os.listdir(calls))
    assert 0 < len(before) < 7
    once = {name for name in first if os.path.getsize(f"{calls}/{name}") == 1}
    changed = rows.withColumn("full_input", F.lit("other"))  # what was asked at first counts
    got = I.infer_in_chunks(changed, _model(False), path, **settings).collect()
    assert sorted((r["id"], r["raw_response"]) for r in got) == [(i, f"T{i}") for i in range(60)]
    again = {name for name in os.listdir(calls) if os.path.getsize(f"{calls}/{name}") > 1}
    assert len(once - again) >= sum(before.values())  # chunks on record weren't asked again
    size = lambda: sum(os.path.getsize(f"{calls}/{n}") for n in os.listdir(calls))
    total = size()
    assert I.infer_in_chunks(rows, _model(False), path, **settings).count() == 60 and size() == total
    assert spark.read.parquet(f"{path}/chunks").count() == 7


def test_inference_in_parts_and_without_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, full_input string")
    upper = lambda: lambda texts: [t.upper() for t in texts]
    settings = {"key": "id", "chunks": 4, "at_once": 2}
    part = I.infer_in_chunks(rows, upper, f"{tmp_path}/a", most=0, **settings)
    assert part.count() == 0 and part.columns == ["id", "full_input", "raw_response", "error"]
    some = I.infer_in_chunks(rows, upper, f"{tmp_path}/a", most=3, **settings).count()
    assert some < 20 == I.infer_in_chunks(rows, upper, f"{tmp_path}/a", **settings).count()
    assert I.infer_in_chunks(rows.limit(0), upper, f"{tmp_path}/b", **settings).count() == 0


def test_append_once(spark, tmp_path):
    path = f"{tmp_path}/results"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert resume.append_once(rows, path, "id").count() == 2
    more = rows.unionByName(spark.createDataFrame([(3, "c")], "id int, v string"))
    assert resume.append_once(more, path, "id").count() == 3
    assert values(resume.pending(more, rows, "id"), "id") == [3]


def test_csv_and_sidecar(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "x",\ny', ["a", "b"]), (2, "n", [])], "id int, p string, tags array<string>")
    path = K.write_csv_preview(rows, f"{tmp_path}/csv")
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    assert {tuple(r) for r in back.collect()} == {("1", 'say "x",\ny', "a, b"), ("2", "n", None)}
    labelled = K.label_valid(rows)
    K.write_records(labelled, f"{tmp_path}/out", partition_by=["kind"])
    assert values(spark.read.parquet(f"{tmp_path}/out/kind=invalid"), "id") == [2]


def test_statistics_and_versions(spark, tmp_path):
    stats = spark.createDataFrame([(3, 2)], "original_tags int, final_tags int")
    top = spark.createDataFrame([("c", 5), ("a", 5), ("b", 9)], "canonical string, n long")
    done = K.statistics_json(stats, top, min_support=40, min_confidence=0.99)
    assert json.loads(done.first()["value"]) == {
        "statistics": {"original_tags": 3, "final_tags": 2},
        "parameters": {"min_support": 40, "min_confidence": 0.99},
        "top": [{"canonical": "b", "n": 9}, {"canonical": "a", "n": 5}, {"canonical": "c", "n": 5}],
    }
    mapping = spark.createDataFrame([("a", "b")], "tag string, canonical string")
    assert spark.read.json(K.write_json(mapping, f"{tmp_path}/mapping")).count() == 1
    assert spark.read.parquet(K.write_version(stats, f"{tmp_path}/v", "0102_0304")).count() == 1
    with pytest.raises(Exception, match="exists"):
        K.write_version(stats, f"{tmp_path}/v", "0102_0304")


def test_stream_tagging_runs_once_per_file(spark, tmp_path):
    schema = "sample_id long, raw_response string"
    mapping = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "c")], "tag string, canonical string")
    paths = [f"{tmp_path}/{p}" for p in ("in", "out", "progress")]

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(paths[0])

    def run():
        done = jobs.run_tagging(spark, paths[0], schema, mapping, paths[1], paths[2], parse=J.tags_comma)
        return sorted((r["sample_id"], r["tags"]) for r in done.collect())

    arrive([(1, "b, c, a"), (2, "nothing")])
    assert run() == [(1, "A,c")]
    assert run() == [(1, "A,c")]
    arrive([(3, "c")])
    assert run() == [(1, "A,c"), (3, "c")]


def test_stream_stores_a_sample_once(spark, tmp_path):
    """Repeats within a file, in a later file, after a restart; ids older than the span are forgotten."""
    schema = "sample_id long, raw_response string, ts timestamp"
    mapping = spark.createDataFrame([("a", "a"), ("b", "b")], "tag string, canonical string")
    paths = [f"{tmp_path}/{p}" for p in ("in", "out", "progress")]
    at = lambda hour: datetime.datetime(2024, 1, 1, hour)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(paths[0])

    def run():
        done = jobs.run_tagging_once(
            spark, paths[0], schema, mapping, paths[1], paths[2], within="2 hours", files_at_once=1, parse=J.tags_comma
        )
        return sorted((r["sample_id"], r["tags"]) for r in done.collect())

    arrive([(1, "a", at(0)), (1, "a", at(0)), (2, "b", at(0)), (None, "a", at(0)), (9, "a", None)])
    arrive([(1, "b", at(1)), (3, "a", at(1))])
    assert run() == [(1, "a"), (2, "b"), (3, "a")]
    arrive([(2, "a", at(1)), (4, "a", at(1))])  # a restart
    assert run() == [(1, "a"), (2, "b"), (3, "a"), (4, "a")]
    arrive([(5, "a", at(20))])
    run()
    arrive([(6, "b", at(21)), (1, "b", at(20))])  # 1 was forgotten
    assert run() == [(1, "a"), (1, "b"), (2, "b"), (3, "a"), (4, "a"), (5, "a"), (6, "b")]


def test_vocabulary_promotes_a_tag_once(spark, tmp_path):
    paths = [f"{tmp_path}/{p}" for p in ("in", "out", "progress")]

    def run(tags):
        frame = spark.createDataFrame([(t, 1) for t in tags], "tag string, n int")
        frame.repartition(2).write.mode("append").parquet(paths[0])
        stream = spark.readStream.schema("tag string, n int").option("maxFilesPerTrigger", 1).parquet(paths[0])
        done = jobs.run_to_files(jobs.running_vocabulary(stream, 3), paths[1], paths[2])
        return sorted((r["tag"], r["n"] >= 3) for r in done.collect())

    assert run(["a", "a", "b", None, None, None, "c"]) == []
    assert run(["a", "b", "c"]) == [("a", True)]
    assert run(["a", "a", "c", "d"]) == [("a", True), ("c", True)]
    assert run(["a"] * 9 + ["c"] * 5 + ["b"] * 9) == [("a", True), ("b", True), ("c", True)]


def test_stream_counts_wait_for_the_watermark(spark, tmp_path):
    stamps = ["2024-01-01 00:05:00", "2024-01-01 00:50:00", "2024-01-01 01:10:00", "2024-01-01 02:05:00"]
    rows = spark.createDataFrame([(s, "t") for s in stamps], "ts string, tag string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    done = jobs.run_to_files(jobs.windowed_tag_counts(stream), f"{tmp_path}/out", f"{tmp_path}/progress")
    # The watermark is 01:55, so only the first hour is final.
    assert [(str(r["window_start"]), r["n"]) for r in done.collect()] == [("2024-01-01 00:00:00", 2)]


def test_shared_dir_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from tagloom.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_damaged_files_are_named(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS sample_id", "uuid() AS text")
    rows.coalesce(1).write.parquet(str(tmp_path / "good"))
    rows.coalesce(1).write.parquet(str(tmp_path / "cut"))
    rows.coalesce(1).write.parquet(str(tmp_path / "torn"))
    (cut,) = (tmp_path / "cut").glob("part-*.parquet")
    cut.write_bytes(cut.read_bytes()[:200])
    (torn,) = (tmp_path / "torn").glob("part-*.parquet")
    whole = torn.read_bytes()
    torn.write_bytes(whole[:30] + b"\xff" * 4000 + whole[4030:])  # footer intact, pages not
    for name in ("cut", "torn"):  # "refused" keeps the checksum that its bytes no longer have
        (tmp_path / name / f".{(cut if name == 'cut' else torn).name}.crc").unlink()
    rows.coalesce(1).write.parquet(str(tmp_path / "refused"))
    (refused,) = (tmp_path / "refused").glob("part-*.parquet")
    refused.write_bytes(b"x" * refused.stat().st_size)
    (tmp_path / "empty.parquet").write_bytes(b"")  # passed over by every scan
    found = S.file_outcomes(spark, str(tmp_path), "sample_id long, other string").collect()
    by_source = {r["source"]: r for r in found}
    assert set(by_source) == {"good", "cut", "torn", "refused"}
    assert (by_source["good"]["n_rows"], by_source["good"]["error"]) == (1000, None)
    assert by_source["refused"]["error"] == "not readable"
    for name in ("cut", "torn", "refused"):
        assert by_source[name]["n_rows"] is None and by_source[name]["error"]
    assert by_source["cut"]["file_path"].endswith(cut.name) and by_source["cut"]["length"] == 200
