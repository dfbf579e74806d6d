"""Positions in files, p-values as columns, and keys known to a growing table."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beta import correlation_p
from voteframe.functions.probability import p_value
from voteframe.operators import voting
from voteframe.sources import positions, readers
from voteframe.streaming import ingest, known_keys


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "3k", "spark.sql.files.openCostInBytes": "1k"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def test_ids_of_a_file_read_in_many_splits(spark, tmp_path, small_splits):
    texts = [f"problem {i} " + "x" * (i * 7 % 83) for i in range(1500)]
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join(json.dumps({"problem": t} | ({"id": f"own{i}"} if i % 10 == 3 else {})) for i, t in enumerate(texts)) + "\n")
    rows = spark.read.schema("id string, problem string").json(str(path))
    assert rows.select(F.col("_metadata.file_block_start")).distinct().count() > 10
    got = {r.problem: r.id for r in readers.read_problems(spark, str(path)).collect()}
    assert got == {t: f"own{i}" if i % 10 == 3 else f"problem_{i}" for i, t in enumerate(texts)}
    assert readers.read_problems(spark, str(path), default_ids=False).where("id is null").count() == 1350


def test_positions_go_on_from_file_to_file(spark, tmp_path, small_splits):
    n = 0
    for name, lines in (("b", 700), ("a", 300), ("c", 0), ("d", 1)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {i}\n" for i in range(lines)))
    rows = positions.read_numbered(spark, str(tmp_path), kind="text", name="at").orderBy("at").collect()
    want = [f"{f} {i}" for f, k in (("a", 300), ("b", 700), ("d", 1)) for i in range(k)]
    assert [(r.at, r.value) for r in rows] == list(enumerate(want))


def test_positions_in_parquet_and_without_rows(spark, tmp_path, small_splits):
    path = str(tmp_path / "t.parquet")
    spark.range(5000).coalesce(1).write.option("parquet.block.size", "4096").parquet(path)
    assert positions.read_numbered(spark, path, kind="parquet").where("position = id").count() == 5000
    empty = str(tmp_path / "e.jsonl")
    spark.createDataFrame([], "problem string").write.json(empty)
    assert readers.read_problems(spark, empty).count() == 0


def test_records_without_ids_are_numbered_from_zero(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([("x",)], "problem string").write.parquet(path)
    assert [tuple(r) for r in readers.read_problems(spark, path).select("problem", "id").collect()] == [("x", "problem_0")]


def test_p_values_agree_with_the_incomplete_beta(spark):
    rows = [
        (t / math.sqrt(n - 2 + t * t), n)
        for n in (3, 4, 5, 6, 7, 10, 11, 50, 51, 333, 1000, 1001, 1002, 1003, 5000, 10**5)
        for t in (0.0, 1e-9, 0.01, 0.5, 1, 1.58, 1.7, 2, 2.49, 2.51, 3, 5, 8, 20)
    ]
    rows += [(1.0, 10), (-1.0, 3), (-0.5, 20), (None, 10), (float("nan"), 10), (0.3, 2), (1.0, 10**6), (0.999, 10**6)]
    df = spark.createDataFrame(rows, "r double, n long").coalesce(1).select("r", "n", p_value(F.col("r"), F.col("n")).alias("p"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for row in df.collect():
        want = float(correlation_p(np.array([np.nan if row.r is None else row.r]), np.array([float(row.n)]))[0])
        if np.isnan(want):
            assert row.p is None
        else:
            assert row.p == pytest.approx(want, rel=1e-8, abs=1e-14), row


def test_large_samples_are_nearly_normal(spark):
    rows = [(1 / math.sqrt(n - 1), n) for n in (10**4, 10**6, 10**10, 10**12)]
    df = spark.createDataFrame(rows, "r double, n long")
    for row in df.select("n", p_value(F.col("r"), F.col("n")).alias("p")).collect():
        assert abs(row.p - 0.31731050786) < 3e-1 / row.n + 1e-10


def test_softmax_draws_follow_the_probabilities(spark):
    scores = [0.0, 1.0, 2.5, -1.0]
    df = spark.range(6000).select(F.concat(F.lit("p"), "id").alias("problem_id"), F.posexplode(F.array(*map(F.lit, scores))).alias("response_idx", "s"))
    got = {r.response_idx: r["count"] for r in voting.softmax_sample(df, "s", 1.5, text="s").groupBy("response_idx").count().collect()}
    share = np.exp(np.array(scores) / 1.5) / np.exp(np.array(scores) / 1.5).sum()
    for i, p in enumerate(share):
        assert abs(got.get(i, 0) / 6000 - p) < 4 * math.sqrt(p * (1 - p) / 6000), i
    plan = voting.softmax_sample(df, "s", 1.5, text="s")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def batch(spark, ids):
    return spark.createDataFrame([(f"r{i}", i) for i in ids], "response_id string, n long")


def add(keys, rows, tag):
    new = keys.without_known(rows, tag)
    n = new.count()
    keys.placed(new).withColumn("batch", F.lit(tag)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(keys.out)
    keys.remember(new, tag)
    return n


def test_known_keys_over_folds_and_retries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(known_keys, "FOLD", 2)
    keys = known_keys.KnownKeys(str(tmp_path / "t"), "response_id", buckets=4, words=8)
    assert [add(keys, batch(spark, range(0, 50)), "a-0"), add(keys, batch(spark, range(40, 90)), "a-1")] == [50, 40]
    assert keys.epoch(spark) == 1
    assert add(keys, batch(spark, range(40, 90)), "a-1") == 40  # a retry replaces its own rows
    assert [add(keys, batch(spark, range(0, 100)), "a-2"), add(keys, batch(spark, range(0, 100)), "a-3")] == [10, 0]
    assert keys.epoch(spark) >= 2
    table = spark.read.parquet(keys.out)
    assert table.count() == table.select("response_id").distinct().count() == 100


def test_new_keys_do_not_read_the_table_and_known_ones_only_their_buckets(spark, tmp_path, monkeypatch):
    keys = known_keys.KnownKeys(str(tmp_path / "t"), "response_id", buckets=64)
    add(keys, batch(spark, range(500)), "a-0")
    seen = []
    real = keys.in_buckets
    monkeypatch.setattr(keys, "in_buckets", lambda s, schema, wanted, tag: seen.append(sorted(wanted)) or real(s, schema, wanted, tag))
    assert keys.without_known(batch(spark, range(1000, 1400)), "a-1").count() == 400
    assert seen == []  # no key's bits are all set, so the table isn't opened
    assert keys.without_known(batch(spark, [7, 8, 2000]), "a-1").count() == 1
    want = sorted({r.bucket for r in keys.placed(batch(spark, [7, 8])).select("bucket").collect()})
    assert seen == [want]
    table = real(spark, batch(spark, [1]).schema, want, "a-1")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = table._jdf.queryExecution().executedPlan().toString()
    assert table.rdd.map(lambda r: r.response_id).count() < 100 and "ReadSchema: struct<response_id:string>" in files


def test_a_stream_appends_new_keys_only(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = batch(spark, [1]).schema
    seen = []
    for k, ids in enumerate((range(0, 30), range(20, 60), range(0, 60))):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"response_id": f"r{i}", "n": i}) for i in [*ids, *ids]) + "\n")
        rows = ingest.response_stream(spark, str(source), schema)
        ingest.ingest_new(rows, out, str(tmp_path / "mark"), on_batch=lambda *x: seen.append(x), buckets=8).awaitTermination()
    assert seen == [(0, 30, 30), (1, 30, 50), (2, 0, 120)]
    assert spark.read.parquet(out).count() == 60


def test_progress_keeps_two_tables_whatever_the_number_of_batches(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    counted = []
    for k in range(5):
        ids = [f"w{k % 2}"] * (k + 1) + (["w9"] if k == 0 else [])
        (source / f"{k}.json").write_text("\n".join(json.dumps({"worker_replica": w}) for w in ids) + "\n")
        rows = ingest.response_stream(spark, str(source), spark.createDataFrame([], "worker_replica string").schema)
        ingest.stream_progress(rows, str(out), str(tmp_path / "mark")).awaitTermination()
        counted.append({r.worker_replica: r.finished for r in ingest.latest_progress(spark, str(out)).collect()})
    assert counted[0] == {"w0": 1, "w9": 1} and counted[-1] == {"w0": 9, "w1": 6, "w9": 1}
    assert len(list(out.rglob("part-*"))) == 2


def test_listener_reports_received_appended_and_skipped_rows(spark, tmp_path):
    import time

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"response_id": f"r{i % 7}", "n": i}) for i in range(20)) + "\n")
    listener = ingest.IngestListener()
    spark.streams.addListener(listener)
    try:
        rows = ingest.response_stream(spark, str(source), batch(spark, [1]).schema)
        ingest.ingest_new(rows, str(tmp_path / "out"), str(tmp_path / "mark"), on_batch=listener.noted, buckets=4).awaitTermination()
        for _ in range(100):
            if listener.received:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.written == {0: (7, 13)}
    assert [k[1] for k in listener.received] == [0] and min(listener.received.values()) >= 20
