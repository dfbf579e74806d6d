"""Null keys and values on both paths of ordered operators, infinite scores, exact integers, large samples."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import beta
from voteframe.functions import grading
from voteframe.functions.confidence import sliding_means
from voteframe.functions.text import word_count
from voteframe.operators import ordering as o, passk, prompts, voting
from voteframe.operators.curation import group_solutions  # noqa: F401
from voteframe.operators.distributions import positive_statistics, prompt_token_summary
from voteframe.operators.selection import nest_by_problem
from voteframe.session import work_dir
from voteframe.sources.readers import read_solution_results

SCHEMA = "k string, i long, v double, t string"


@pytest.fixture(scope="module")
def holed(spark):
    rows = [(None if i % 10 == 0 else "hot" if i % 3 else "b", i, None if i % 7 == 0 else float(i % 5), None if i == 5 else f"gsm8k_{i:03}") for i in range(100)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("call", [
    lambda d, hot: o.row_numbers(d, ["k"], "i", hot_rows=hot),
    lambda d, hot: o.row_numbers(d, ["k"], "t", hot_rows=hot),
    lambda d, hot: o.running_totals(d, ["k"], "i", {"row_no": F.coalesce("v", F.lit(0.0))}, hot_rows=hot),
    lambda d, hot: o.ranked(d, ["k"], "v", "i", hot_rows=hot),
])
def test_size_decides_the_plan_and_not_the_rows(holed, call):
    plain, chunked = ({r.i: r.row_no for r in call(holed, hot).collect()} for hot in (1000, 20))
    assert len(plain) == 100 and plain == chunked


def test_null_order_values_without_keys(holed):
    rows = {r.i: r.row_no for r in o.row_numbers(holed, [], "t").collect()}
    assert len(rows) == 100 and rows[5] == 0


@pytest.mark.parametrize("temperature", [0.0, 1.0])
def test_softmax_sample_keeps_null_problems(spark, temperature):
    df = spark.createDataFrame([(p, i, str(i), 0.5) for p in (None, "a") for i in range(3)], "problem_id string, response_idx long, generated_text string, s double")
    assert voting.softmax_sample(df, "s", temperature).count() == 2


def test_null_split_keeps_its_statistics(spark):
    df = spark.createDataFrame([(5, None), (7, None), (9, "a")], "prompt_token_count long, split string")
    rows = {r.dataset: r for r in prompt_token_summary(df).collect()}
    assert rows[None].samples == 2 and rows[None]["mean"] == 6.0


def test_null_key_keeps_its_statistics_and_classes(spark):
    df = spark.createDataFrame([(5, None), (7, None), (0, None), (9, "a")], "v long, k string")
    rows = {r.k: r for r in positive_statistics(df, "v", ["k"]).collect()}
    assert rows[None].total == 3 and rows[None].positive == 2 and rows[None]["mean"] == 6.0 and rows[None]["median"] == 6.0


@pytest.mark.parametrize("order, kept", [([0, 1, 2], True), ([0, 0, 2], False), ([1, 2, 3], False), ([0, 1, 1, 3, 5, 5, 6, 7], False), ([None, 1], False)])
def test_positions_are_never_repeated(spark, order, kept):
    df = spark.createDataFrame([("p", i) for i in order], "k string, i long")
    rows = o.with_positions(df, ["k"], "i", "pos").collect()
    assert sorted(r.pos for r in rows) == list(range(len(order)))
    assert not kept or all(r.pos == r.i for r in rows)


@pytest.mark.parametrize("values", [[1, np.inf, 1, 1, 1, 1], [1, -np.inf, 2, np.inf, 1, 3, 4], [np.nan, 1, 2, 3, np.inf, 1, 1], [1, 2, 3, 4]])
def test_infinite_tokens_touch_their_windows_only(values):
    x = np.array(values, float)
    with np.errstate(invalid="ignore"):
        want = np.array([x[i : i + 2].sum() / 2 for i in range(len(x) - 1)])
    np.testing.assert_array_equal(sliding_means(x, 2), want)


def test_grading_of_long_integers_and_spaced_numbers(spark):
    cases = [("12345678901", "12345678902", False), ("12345678901", "12,345,678,901", True), ("3 4", "34", False), ("+007", "7", True),
             ("-0", "0", True), ("1" * 60, "1" * 60 + ".0", True), (" 5 ", "5", True), ("$ 5", "5", True), ("0.5", "1/2", True), ("-3", "3", False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    got = [r.x for r in df.select(grading.is_correct_equivalent(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [w for _, _, w in cases]


def test_word_count_matches_split(spark):
    texts = ["", None, " a  b\tc\n", "x", " y z ", "\x1ca\x1fb"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()]
    assert got == [len((t or "").split()) for t in texts]


def test_p_values_of_large_samples():
    r = lambda n: 1 / np.sqrt(n - 1.0)  # noqa: E731  t = 1
    for n in (1e4, 1e6, 9e6, 1e10, 1e12):
        assert abs(beta.correlation_p(np.array([r(n)]), np.array([n]))[0] - 0.3173105) < 3e-5 / min(n / 1e4, 10)
    for n in range(3, 40):  # whole degrees of freedom: the finite sum of Student's t
        t, df = 1.3, n - 2
        theta = np.arctan(t / np.sqrt(df))
        c, s = np.cos(theta), np.sin(theta)
        if df % 2:
            terms, total = c, 0.0
            for j in range(1, (df - 1) // 2 + 1):
                total += terms
                terms *= c * c * (2 * j) / (2 * j + 1)
            inside = 2 / np.pi * (theta + s * total)
        else:
            terms, total = 1.0, 0.0
            for j in range(1, df // 2 + 1):
                total += terms
                terms *= c * c * (2 * j - 1) / (2 * j)
            inside = s * total
        got = beta.correlation_p(np.array([t / np.sqrt(df + t * t)]), np.array([float(n)]))[0]
        assert abs(got - (1 - inside)) < 1e-12, n


def test_default_variants_follow_the_number_of_metrics():
    ids = [v["variant_id"] for v in prompts.build_variants(list("abcde"))]
    assert ids[0] == "without_confidence" and ids[-1] == "all_confidence__a__b__c__d__e" and len(ids) == 1 + 5 + 10 + 10 + 1


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        work_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=context))


GAPS = [(p, i, a, "a", 1.0, a == "a", float(a == "a")) for p in (None, "p") for i, a in enumerate("abbaabab")]
VOTES = "problem_id string, response_idx long, final_answer string, ground_truth string, s double, is_correct boolean, reward double"


@pytest.mark.parametrize("call", [
    lambda d: voting.set_votes(d, [2, 3, 4], ["s"]),
    lambda d: voting.set_votes_fixed16(d, ["s"]),
    passk.pass_at_k,
    passk.pass_at_k_fixed,
    lambda d: passk.group_advantages(d, 3).drop("response_idx"),
    lambda d: passk.group_statistics(d, 3),
])
def test_gaps_in_positions_do_not_matter(spark, call):
    dense = spark.createDataFrame(GAPS, VOTES)
    holed = dense.withColumn("response_idx", 5 + F.col("response_idx") * 3 + F.when(F.col("response_idx") > 4, 40).otherwise(0))
    rows = [sorted(map(repr, call(d).collect())) for d in (dense, holed)]
    assert rows[0] and rows[0] == rows[1]


def test_nested_blocks_keep_positions(spark, tmp_path):
    df = spark.createDataFrame([("p", 10 + 2 * i, str(i)) for i in range(11)], "problem_id string, response_idx long, final_answer string")
    nested = nest_by_problem(df, ["final_answer"], block=4)
    assert sorted((r.start, len(r.solutions)) for r in nested.collect()) == [(0, 4), (4, 4), (8, 3)]
    nested.select(F.array(F.struct("problem_id", "start", "solutions")).alias("generated_solutions")).write.json(str(tmp_path / "n"))
    rows = read_solution_results(spark, str(tmp_path / "n"), multi_line=False).collect()
    assert sorted((r.response_idx, r.final_answer) for r in rows) == sorted((i, str(i)) for i in range(11))
    lists = nested.select("problem_id", "start", F.transform("solutions", lambda s: s["final_answer"]).alias("predictions"), F.lit("9").alias("ground_truth"))
    got = {r.k: r.pass_at_k for r in passk.pass_at_k_list(lists, [9, 10], start="start").collect()}
    assert got == {9: 0.0, 10: 1.0}
