"""Set building: sizes, repeats, splits, and one problem holding most of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voteframe.operators import curation as cu, prompts as pr


@pytest.fixture(scope="module")
def responses(spark):
    rng = np.random.default_rng(11)
    counts = {"p_hot": 400, "p3": 3, "p9": 9, "p16": 16, "p20": 20}
    rows = [
        (p, f"text of {p}", "1", i * 2, f"g{i}", f"c{i}" if i % 3 else None, str(rng.integers(0, 3)), int(i * 10), float(i), float(i), None)
        for p, n in counts.items() for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "problem_id string, problem_text string, ground_truth string, response_idx int, generated_text string, content string, "
        "final_answer string, output_token_count int, mean_group_confidence double, bottom_10_percent_confidence double, tail_confidence double",
    ).cache()


def sets_of(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.problem_id, r.set_size, r.set_no), []).append((r.slot, r.response_idx))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("hot_rows", [1000, 50])
def test_sets_without_fill(responses, hot_rows):
    sets = sets_of(cu.make_sets(responses, 4, [4], hot_rows=hot_rows))
    per_problem = {}
    for (p, _, _), members in sets.items():
        assert sorted(s for s, _ in members) == [0, 1, 2, 3]
        per_problem.setdefault(p, []).extend(i for _, i in members)
    assert {p: len(x) // 4 for p, x in per_problem.items()} == {"p_hot": 4, "p9": 2, "p16": 4, "p20": 4}
    for used in per_problem.values():
        assert len(used) == len(set(used))  # nobody is used twice
    # Too few for sampling: own order, remainder dropped.
    assert [i for k in (0, 1) for _, i in sorted(sets[("p9", 4, k)])] == [0, 2, 4, 6, 8, 10, 12, 14]


@pytest.mark.parametrize("num, fill", [(4, False), (300, True)])
def test_both_paths_choose_the_same(responses, num, fill):
    lost = F.when(F.col("problem_id") != "p20", F.col("problem_id")).alias("problem_id")
    holed = responses.select(lost, *responses.columns[1:])  # a null problem is a group
    first, chunked = (sets_of(cu.make_sets(holed, num, [4, 2], fill, hot_rows=hot)) for hot in (1000, 10))
    assert chunked == first
    if fill:
        assert len([k for k in first if k[:2] == (None, 4)]) == num


def test_smallest_digests_keep_enough_and_little_more(responses, spark):
    rows = spark.range(20_000).selectExpr("if(id % 4 = 0, null, id % 4) AS k", "id", "md5(cast(id AS string)) AS d")
    every = {}
    for r in rows.collect():
        every.setdefault(r.k, []).append(r.d)
    for most in (1, 50, 4_999, 5_000, 10**9):
        kept = {}
        for r in cu.smallest_digests(rows, ["k"], "d", most, "n").collect():
            assert r.n == 5_000
            kept.setdefault(r.k, []).append(r.d)
        assert set(kept) == set(every)
        for k, digests in kept.items():
            assert sorted(digests)[:most] == sorted(every[k])[:most]
            assert len(digests) <= max(4 * most, 40)


def test_many_sets_of_one_problem_spread_over_tasks(spark):
    df = spark.range(300_000).selectExpr("if(id < 299990, 'p', 'q') AS problem_id", "cast(id AS int) AS response_idx")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sets = cu.make_sets(df, 50_000, [4], hot_rows=10_000)
        per_task = [r["count"] for r in sets.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(per_task) == 200_008 and max(per_task) < 60_000
    assert sets.select("response_idx").distinct().count() == 200_008


def test_fill_repeats_short_problems(responses):
    sets = sets_of(cu.make_sets(responses, 2, [4], fill=True))
    p3 = [i for k in (0, 1) for _, i in sorted(sets[("p3", 4, k)])]
    assert p3[:3] == [0, 2, 4] and len(p3) == 8 and set(p3) == {0, 2, 4}


def test_records_and_prompt(responses):
    sets = cu.set_records(cu.make_sets(responses.where("problem_id = 'p9'"), 4, [4]), "bottom_10_percent_confidence")
    row = sets.where("set_no = 0").first()
    assert row.solutions[0].content == "g0" and row.solutions[1].content == "c1"
    assert row.selected_confidence == [0.0, 1.0, 2.0, 3.0]
    assert row.confidence_scores.tail_confidence == [None] * 4
    assert row.prompt.startswith("Given the following problem:\ntext of p9\nand these solution attempts:\nsolution1:\ng0\nfinal_answer: ")
    assert "confidence: 1.0000\n\nsolution3:" in row.prompt


def test_missing_confidence_is_na(responses):
    row = cu.set_records(cu.make_sets(responses.where("problem_id = 'p9'"), 1, [4]), "tail_confidence").first()
    assert row.prompt.count("confidence: N/A") == 4


@pytest.mark.parametrize("strategy, sizes", [("naive", {4}), ("multitask", {4, 2, 1})])
def test_curate_keeps_problems_together(responses, strategy, sizes):
    out = cu.curate(responses, 4, 4, strategy).select("set_size", "problem_id", "set_id", "difficulty", "split").collect()
    assert {r.set_size for r in out} == sizes
    homes = {}
    for r in out:
        homes.setdefault((r.set_size, r.problem_id), set()).add(r.split)
    assert all(len(s) == 1 for s in homes.values())
    for size in sizes:
        hard = sum(r.difficulty == "hard" and r.set_size == size for r in out)
        easy = sum(r.difficulty == "easy" and r.set_size == size for r in out)
        assert easy <= hard // 2
        problems = {r.problem_id: r.split for r in out if r.set_size == size}
        assert sum(s == "train" for s in problems.values()) == int(len(problems) * 0.8)


def test_halving_sizes():
    assert cu.halving_sizes(4) == [4, 2, 1] and cu.halving_sizes(6) == [6, 3, 1] and cu.halving_sizes(1) == [1]


def test_cleaning(responses):
    kept = cu.clean_responses(responses, 130)
    assert {r.problem_id: r["count"] for r in kept.groupBy("problem_id").count().collect()} == {
        "p_hot": 13, "p9": 9, "p16": 13, "p20": 13,
    }
    assert cu.clean_responses(responses.drop("output_token_count", "final_answer")).count() == 445


@pytest.mark.parametrize("max_groups", [None, 3, 400])
def test_group_solutions(responses, max_groups):
    out = cu.group_solutions(responses, 4, max_groups, hot_rows=40)
    got = {r.problem_id: r["count"] // 4 for r in out.groupBy("problem_id").count().collect()}
    full = {"p_hot": 100, "p9": 2, "p16": 4, "p20": 5}
    assert got == {p: min(n, max_groups or n) for p, n in full.items()}
    first = [r.response_idx for r in out.where("problem_id = 'p9' and group_idx = 1").orderBy("slot").collect()]
    assert first == [8, 10, 12, 14]


def test_variants():
    metrics = {"a": "A", "b": "B"}
    subsets = [
        {"name": "none", "include_confidence": False}, {"name": "pair", "subset_size": 5},
        {"name": "given", "subset_size": 1, "combinations": [["b"]]}, {"name": "one", "subset_size": 1},
    ]
    assert [x["variant_id"] for x in pr.build_variants(metrics, subsets)] == ["none", "pair__a__b", "given__b", "one__a", "one__b"]
    with pytest.raises(ValueError):
        pr.build_variants(metrics, [])


def test_variant_styles(spark):
    df = spark.createDataFrame(
        [("q {solutions}", [("c", "1", {"tail_confidence": 0.12345})])],
        "problem string, solutions array<struct<content string, final_answer string, confidence_scores map<string, double>>>",
    )
    keys = F.array(F.lit("tail_confidence"), F.lit("mean_group_confidence"))
    one = F.array(F.lit("tail_confidence"))
    text = lambda style, k: df.select(pr.variant_blocks(F.col("solutions"), k, style).alias("o")).first().o
    head = "Solution 1:\nc\nfinal_answer: 1"
    assert text("without_confidence", keys) == head
    assert text("confidence_no_guidance", one) == head + "\nConfidence score: 0.123"
    assert text("confidence_no_guidance", keys) == head + "\nConfidence score 1: 0.123\nConfidence score 2: N/A"
    assert text("confidence_full_guidance", one) == head + "\nTail Confidence score: 0.123"
    assert text("other", keys) == head + "\nconfidence scores:\n- Tail: 0.1235\n- Mean: N/A"
    assert text("default", F.array().cast("array<string>")) == head
    full = df.select(pr.variant_prompt(F.col("problem"), F.col("solutions"), one, "default").alias("o")).first().o
    assert "following problem:\nq {solutions}\nand these" in full
