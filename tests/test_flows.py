"""End-to-end flows on small files."""

import json

import pytest
from pyspark.sql import functions as F

from catalog import fixtures as fx
from voteframe.operators import voting as v
from voteframe.plans.analysis import merge_and_report, recalculate_file
from voteframe.plans.curation import curate_to
from voteframe.plans.evaluation import evaluate_files
from voteframe.session import spread

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def responses(spark):
    df = fx.responses(spark, SF_DIR).drop("final_answer", "content", "is_correct")
    return df.withColumn("logprobs", F.array(F.array(F.col("value"), F.col("value") + 1)))


def test_merge_and_report(spark, responses, tmp_path):
    for name in ("shard_0", "shard_1", "shard_2", "shard_3"):
        responses.where(F.col("worker_replica") == name).write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    reports = merge_and_report(spark, str(tmp_path / "in"), str(tmp_path / "parsed"))
    parsed = spark.read.parquet(str(tmp_path / "parsed"))
    assert parsed.count() == responses.count() and "logprobs" not in parsed.columns
    comparison = {r.method: r for r in reports["method_comparison"].collect()}
    assert comparison["exact"].correct == parsed.where("is_correct_exact").count()
    votes = v.problem_votes(parsed)
    assert comparison["weighted_tail"].correct == votes.where("is_correct_weighted_tail").count()
    for name, df in reports.items():
        assert df.count() > 0, name


def test_recalculate_file(spark, responses, tmp_path):
    source, out = str(tmp_path / "a"), str(tmp_path / "b")
    responses.withColumn("logprobs", F.when(F.col("event_id") % 10 != 0, F.col("logprobs"))).write.parquet(source)
    total = responses.count()
    counts = recalculate_file(spark, source, out, 5)
    assert counts == {"total": total, "valid": total - total // 10, "invalid": total // 10}
    assert "logprobs" not in spark.read.parquet(out).columns


def test_curate_to(spark, tmp_path):
    out = str(tmp_path / "sets")
    df = fx.responses(spark, SF_DIR)
    curate_to(df, out, "curriculum", 4, 2, clean=True, token_threshold=4800)
    assert {p.name for p in (tmp_path / "sets").iterdir() if p.is_dir()} == {"set_size=1", "set_size=2", "set_size=4"}
    train = spark.read.parquet(f"{out}/set_size=4/split=train")
    assert train.first().prompt.startswith("Given the following problem") and len(train.first().solutions) == 4


def test_evaluate_files(spark, tmp_path):
    def solution(answer, score):
        return {"generated_text": "", "content": "", "final_answer": answer, "confidence_scores": {"tail_confidence": score}}

    for model, answers in (("baseline", "abab"), ("tuned", "aabb")):
        doc = {
            "dataset_name": "d", "total_problems": 1,
            "generated_solutions": [{"problem_id": "0", "problem_text": "q", "ground_truth": "a", "solutions": [solution(a, 1.0) for a in answers]}],
        }
        (tmp_path / f"{model}.json").write_text(json.dumps(doc, indent=1))
    metrics, overall = evaluate_files(spark, {m: str(tmp_path / f"{m}.json") for m in ("baseline", "tuned")})
    got = {(r.model, r.metric, r.size): r.value for r in metrics.collect()}
    assert got[("baseline", "pass_at_k", 1)] == 1.0
    assert got[("baseline", "majority_voting", 2)] == 1.0  # ties go to the first answer
    assert got[("tuned", "majority_voting", 2)] == 0.5
    assert got[("tuned", "tail_confidence", 4)] == 1.0
    assert overall.count() == len(got)


def test_spread_only_small_inputs(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100, numPartitions=1), "id").rdd.getNumPartitions() == cores
    wide = spark.range(100, numPartitions=cores + 3)
    assert spread(wide, "id") is wide
