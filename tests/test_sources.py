"""Readers, writers, merges and streams on temporary folders."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from voteframe import schemas
from voteframe.session import cut_lineage, new_folder, work_dir
from voteframe.sources import readers, shards, writers
from voteframe.streaming import ingest


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_read_problems(spark, tmp_path):
    path = lines(tmp_path / "p.jsonl", [{"id": "a", "problem": "1+1", "answer": "2"}, {"problem": "x"}])
    df = readers.with_default_ids(readers.read_problems(spark, path), "problem")
    got = {tuple(r) for r in readers.canonical_problems(df).collect()}
    assert got == {("a", "1+1", "2"), ("problem_1", "x", "")}
    with pytest.raises(ValueError):
        readers.read_problems(spark, "problems.txt")


def test_problem_lookup_is_pushed_down(spark, tmp_path):
    out = str(tmp_path / "responses")
    spark.createDataFrame([], schemas.RESPONSES).write.parquet(out)
    plan = readers.read_responses(spark, out, "p1").select("response_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(problem_id,p1)" in plan and "logprobs" not in plan.split("ReadSchema")[1]


def test_multi_line_results(spark, tmp_path):
    doc = {
        "dataset_name": "d", "total_problems": 1,
        "generated_solutions": [
            {
                "problem_id": "0", "problem_text": "q", "ground_truth": "1",
                "solutions": [
                    {"generated_text": "g", "reasoning_content": "", "content": "c", "final_answer": "1", "confidence_scores": {"tail_confidence": 0.5}},
                    {"generated_text": "h", "content": "e", "final_answer": ""},
                ],
            }
        ],
    }
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=2))
    rows = readers.read_solution_results(spark, str(tmp_path / "r.json")).orderBy("response_idx").collect()
    assert [(r.problem_id, r.response_idx, r.final_answer) for r in rows] == [("0", 0, "1"), ("0", 1, "")]
    assert rows[0].confidence_scores == {"tail_confidence": 0.5}


def test_text_lists(spark):
    df = spark.createDataFrame([("['a', 'it''s']".replace("''", "\\'"),), ("plain",), ("[broken",)], "v string")
    got = [r.o for r in df.select(readers.parse_text_list(F.col("v")).alias("o")).collect()]
    assert got == [["a", "it's"], ["plain"], ["[broken"]]


@pytest.mark.parametrize("name, expected", [("other", "\\boxed{ 7 }"), ("aime24", "7")])
def test_normalize_benchmark(spark, name, expected):
    df = spark.createDataFrame([(2, "q2", None), (1, "q1", "\\boxed{ 7 }")], "i int, question string, answer string")
    rows = readers.normalize_benchmark(df, name, "i").orderBy("problem_id").collect()
    assert [tuple(r) for r in rows] == [(0, "q1", expected), (1, "q2", None)]


def test_numeric_answer(spark):
    texts = ["x #### 42 apples", "a 1 b 22.", "none", "####"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    assert [r.o for r in df.orderBy("i").select(readers.numeric_answer(F.col("v")).alias("o")).collect()] == ["42", "22", "0", "0"]


def test_merge_shards(spark, tmp_path):
    folder = tmp_path / "shards"
    spark.createDataFrame([("a", 1)], "id string, x int").write.parquet(str(folder / "one.parquet"))
    spark.createDataFrame([("b", "t")], "id string, generated_text string").write.parquet(str(folder / "two.parquet"))
    spark.createDataFrame([("c",)], "id string").write.parquet(str(folder / "merged.parquet"))
    merged = shards.merge_shards(spark, str(folder), "merged.parquet")
    assert {(r.id, r.x, r.generated_text) for r in merged.collect()} == {("a", 1, None), ("b", None, "t")}
    out = str(tmp_path / "slim")
    full = shards.merge_shards_slim(spark, str(folder), out, "merged.parquet")
    assert "generated_text" in full.columns and "generated_text" not in spark.read.parquet(out).columns
    with pytest.raises(ValueError):
        shards.union_all([])


def test_merge_only_same_keys(spark):
    make = lambda *keys: spark.createDataFrame([(k,) for k in keys], "problem_id string")
    assert shards.merge_if_same_keys(make("a", "b"), make("b", "a", "a")).count() == 5
    assert shards.merge_if_same_keys(make("a"), make("a", "b")).count() == 0


def test_jsonl_to_parquet(spark, tmp_path):
    schema = readers.string_schema("id")
    path = lines(tmp_path / "a.jsonl", [{"id": "1"}])
    warned = []
    df = writers.jsonl_to_parquet(spark, [path, str(tmp_path / "none.jsonl")], str(tmp_path / "o"), schema, warned.append)
    assert df.count() == 1 and len(warned) == 1
    with pytest.raises(FileNotFoundError):
        writers.jsonl_to_parquet(spark, [str(tmp_path / "none.jsonl")], str(tmp_path / "p"), schema, warned.append)


def test_upsert_replaces_only_its_aggregator(spark, tmp_path):
    path = str(tmp_path / "summary")
    make = lambda rows: spark.createDataFrame(rows, "dataset string, group_size int, aggregator string, correct int")
    writers.upsert_summary(make([("d", 4, "a", 1), ("d", 4, "b", 2), ("e", 4, "a", 3)]), path)
    writers.upsert_summary(make([("d", 4, "a", 9)]), path)
    got = {(r.dataset, r.aggregator, r.correct) for r in spark.read.parquet(path).collect()}
    assert got == {("d", "a", 9), ("d", "b", 2), ("e", "a", 3)}


def test_write_table_kinds(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, x int")
    for kind in ("parquet", "json", "csv"):
        writers.write_table(df, str(tmp_path / kind), kind, partition_by=["k"])
        assert (tmp_path / kind / "k=a").exists()
    with pytest.raises(ValueError):
        writers.write_table(df, str(tmp_path / "x"), "xml")


def test_work_dir_follows_the_session(spark):
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: {"spark.checkpoint.dir": "/shared/dir/"}[key]))
    assert work_dir(named) == "/shared/dir"
    assert new_folder(named, "x").startswith("/shared/dir/x-")
    assert new_folder(spark, "x") != new_folder(spark, "x")
    assert "Range" not in cut_lineage(spark.range(5))._jdf.queryExecution().executedPlan().toString()


STREAM_SCHEMA = "response_id string, worker_replica string, logprobs array<array<double>>"


def arrive(folder, name, ids):
    lines(folder / name, [{"response_id": i, "worker_replica": "w" + i[-1], "logprobs": [[-1.0], [-3.0]]} for i in ids])


def test_stream_resumes_and_equals_batch(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(STREAM_SCHEMA)
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    arrive(source, "a.json", ["r1", "r2"])
    run = lambda: ingest.stream_ingest_responses(spark, str(source), schema, out, mark, 2).awaitTermination()
    run()
    arrive(source, "b.json", ["r3"])
    run()
    run()
    got = {(r.response_id, r.mean_group_confidence) for r in spark.read.parquet(out).collect()}
    assert got == {("r1", 2.0), ("r2", 2.0), ("r3", 2.0)} and spark.read.parquet(out).count() == 3


def test_ingest_new_skips_known_keys_of_other_streams(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(STREAM_SCHEMA)
    out, seen = str(tmp_path / "out"), []
    for name, ids in (("one", ["r1", "r2", "r2"]), ("two", ["r2", "r3"])):
        source = tmp_path / name
        source.mkdir()
        arrive(source, "a.json", ids)
        rows = ingest.response_stream(spark, str(source), schema)
        ingest.ingest_new(rows, out, str(tmp_path / f"mark-{name}"), on_batch=lambda *x: seen.append(x)).awaitTermination()
    assert sorted(r.response_id for r in spark.read.parquet(out).collect()) == ["r1", "r2", "r3"]
    assert seen == [(0, 2, 1), (0, 1, 1)]


def test_progress(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(STREAM_SCHEMA)
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    for name, ids in (("a.json", ["r1", "r2"]), ("b.json", ["q1"])):
        arrive(source, name, ids)
        ingest.stream_progress(ingest.response_stream(spark, str(source), schema), out, mark).awaitTermination()
    got = {r.worker_replica: r.finished for r in ingest.latest_progress(spark, out).collect()}
    assert got == {"w1": 2, "w2": 1}
