"""Voting, pass@k and rewards on hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voteframe.operators import methods as om, passk as pk, voting as v

COLUMNS = "problem_id string, response_idx int, final_answer string, ground_truth string, tail_confidence double"


def table(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    for name in ("bottom_10_percent_confidence", "lowest_group_confidence", "mean_group_confidence"):
        df = df.withColumn(name, F.col("tail_confidence"))
    return df.withColumn("is_correct", (F.col("final_answer") != "") & (F.col("final_answer") == F.col("ground_truth")))


def test_majority_ties_and_blanks(spark):
    df = table(
        spark,
        [
            ("tie", 0, "", "b", 1.0), ("tie", 1, "b", "b", 1.0), ("tie", 2, "a", "b", 1.0),
            ("tie", 3, " a ", "b", 1.0), ("tie", 4, "b", "b", 1.0),
            ("blank", 0, " ", "", 1.0), ("blank", 1, None, "", 1.0),
            ("one", 0, "X", "x", None),
        ],
    )
    got = {r.problem_id: (r.majority_answer, r.is_correct_majority) for r in v.majority_vote(df).collect()}
    assert got == {"tie": ("b", True), "blank": ("", False), "one": ("X", True)}


def test_weighted_null_and_nan_count_as_zero(spark):
    df = table(
        spark,
        [
            ("p", 0, "a", "b", None), ("p", 1, "a", "b", float("nan")), ("p", 2, "b", "b", 0.1),
            ("q", 0, "c", "c", None), ("q", 1, "d", "c", 0.0),
        ],
    )
    got = {r.problem_id: r.weighted_answer for r in v.weighted_vote(df, "tail_confidence").collect()}
    assert got == {"p": "b", "q": "c"}


def test_attach_votes_keeps_every_row(spark):
    df = table(spark, [("p", 0, "a", "a", 1.0), ("p", 1, "b", "a", 0.5), ("new", 0, "a", "a", 1.0)])
    votes = v.problem_votes(df.where("problem_id = 'p'"))
    out = {(r.problem_id, r.response_idx): r.is_correct_majority for r in v.attach_votes(df, votes).collect()}
    assert out == {("p", 0): True, ("p", 1): True, ("new", 0): False}


def test_set_votes(spark):
    answers = ["a", "b", "", "", "b", "a", "a"]
    df = table(spark, [("p", i, a, "a", 1.0) for i, a in enumerate(answers)])
    got = {
        r.set_size: (r.correct_count, r.total_sets)
        for r in v.set_votes(df, [2, 3, 8]).collect() if r.method == "majority_voting"
    }
    # Pairs: (a b) tie, first wins; ('' '') wrong but counted; (b a) b first. Triples: (a b ''), ('' b a).
    assert got == {2: (1, 3), 3: (1, 2)}


def test_fixed16_votes(spark):
    df = table(spark, [("p", 0, "", "a", 1.0), ("p", 1, "a", "a", 2.0), ("p", 2, "a", "a", 1.0)])
    out = {(r.method, r.set_size): (r.correct_count, r.total_sets) for r in v.set_votes_fixed16(df, ["tail_confidence"]).collect()}
    assert out[("majority_voting", 2)] == (1, 8)  # ('' a): blank votes and was first; (a) is right
    assert out[("tail_confidence", 2)] == (2, 8)
    assert out[("majority_voting", 4)] == (1, 4)
    assert out[("majority_voting", 16)] == (1, 1)
    blank = table(spark, [("p", 0, "a", "", 1.0)])
    out = {r.set_size: r.correct_count for r in v.set_votes_fixed16(blank).collect()}
    assert out == {2: 7, 4: 3, 8: 1, 16: 0}  # missing sets answer '', which this truth accepts


def test_pass_at_k(spark):
    df = table(spark, [("p", i, a, "a", 1.0) for i, a in enumerate("bba")] + [("q", 0, "x", "a", 1.0)])
    got = {(r.problem_id, r.k): r.pass_at_k for r in pk.pass_at_k(df).collect()}
    assert got == {("p", 1): 0.0, ("p", 2): 0.0, ("p", 3): 1.0, ("q", 1): 0.0}
    fixed = {r.problem_id: (r.pass_at_1, r.pass_at_4, r.pass_at_16) for r in pk.pass_at_k_fixed(df).collect()}
    assert fixed == {"p": (0.0, 1.0, 1.0), "q": (0.0, 0.0, 0.0)}


def test_pass_at_k_is_monotone(spark):
    rng = np.random.default_rng(1)
    rows = [(f"p{p}", i, str(rng.integers(0, 4)), "0", 1.0) for p in range(20) for i in range(int(rng.integers(1, 40)))]
    values = {}
    for r in pk.pass_at_k(table(spark, rows)).collect():
        values.setdefault(r.problem_id, []).append((r.k, r.pass_at_k))
    for pairs in values.values():
        passed = [x for _, x in sorted(pairs)]
        assert passed == sorted(passed)


def test_pass_at_k_list(spark):
    df = spark.createDataFrame([(["x", "a"], "a"), (["a"], "a"), ([], "a")], "predictions array<string>, ground_truth string")
    assert {r.k: r.pass_at_k for r in pk.pass_at_k_list(df, [1, 2]).collect()} == {1: pytest.approx(1 / 3), 2: pytest.approx(2 / 3)}
    single = spark.createDataFrame([("a", "a"), ("b", "a")], "predictions string, ground_truth string")
    assert {r.k: r.pass_at_k for r in pk.pass_at_k_list(single, [1, 5]).collect()} == {1: 0.5, 5: 0.5}


def test_best_and_softmax(spark):
    df = table(spark, [("p", 0, "a", "a", 1.0), ("p", 1, "b", "a", 3.0), ("p", 2, "c", "a", 3.0), ("n", 0, "z", "z", None)])
    best = {r.problem_id: r.best_text for r in v.best_by_confidence(df, ["tail_confidence"], "final_answer").collect()}
    assert best == {"p": "b", "n": ""}
    cold = v.softmax_sample(df, "tail_confidence", 0.0, text="final_answer").collect()
    assert [(r.problem_id, r.final_answer) for r in cold] == [("p", "b")]
    many = table(spark, [(f"p{p}", i, str(i), "0", float(i == 1) * 2) for p in range(400) for i in range(3)])
    counts = {r.final_answer: r["count"] for r in v.softmax_sample(many, "tail_confidence", 1.0, text="final_answer").groupBy("final_answer").count().collect()}
    share = np.exp([0, 2, 0]) / np.exp([0, 2, 0]).sum()
    assert sum(counts.values()) == 400
    for i in range(3):
        assert abs(counts[str(i)] / 400 - share[i]) < 0.08


def test_group_advantages_and_statistics(spark):
    rewards = [1.0, 0.0, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([("p", i, r) for i, r in enumerate(rewards)], "problem_id string, response_idx int, reward double")
    got = [r.advantage for r in pk.group_advantages(df, 2).orderBy("response_idx").collect()]
    np.testing.assert_allclose(got, [0.5 / (0.5 + 1e-8), -0.5 / (0.5 + 1e-8), 0.0, 0.0, 0.0])
    stats = pk.group_statistics(df, 2).orderBy("group_no").collect()
    assert [(r.group_mean, r.group_std) for r in stats] == [(0.5, 0.5), (1.0, 0.0)]
    assert stats[0].overall_mean == pytest.approx(0.8)


def test_method_agreement_adds_up(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(bool(x) for x in rng.integers(0, 2, 6)) for _ in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} boolean" for c in om.ALL_METHODS))
    r = om.method_agreement(df).first().asDict()
    assert sum(r[f"exact_equivalent_{x}"] for x in ("both", "neither", "only_exact", "only_equivalent")) == r["total"] == 200
    exclusive = [k for k in r if k.startswith("weighted_")]
    assert sum(r[k] for k in exclusive) == 200
    assert r["all_correct"] == sum(all(x) for x in rows)


def test_set_votes_use_more_tasks_for_more_rows(spark, monkeypatch):
    rows = [(f"p{i // 10}" if i >= 10 else None, i % 10, "ab"[i % 3 % 2], i % 3 == 1, float(i % 7)) for i in range(5000)]
    df = spark.createDataFrame(rows, "problem_id string, response_idx int, final_answer string, is_correct boolean, s double")
    few = v.set_votes(df, [2, 3, 32], ["s"])
    monkeypatch.setattr(v, "TASK_ROWS", 100, raising=False)
    many = v.set_votes(df, [2, 3, 32], ["s"])
    assert many.rdd.getNumPartitions() >= 50
    assert sorted(map(repr, many.collect())) == sorted(map(repr, few.collect())) and many.count() == 500 * 2 * 2
    assert v.set_votes(df.limit(0), [2], ["s"]).count() == 0
