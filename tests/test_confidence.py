"""Scores against a NumPy twin, and p-values against published tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voteframe.functions import confidence as cf, logprobs as lp
from beta import correlation_p
from voteframe.operators import scoring as sc, selection as sel
from voteframe.schemas import SCORE_NAMES


def twin(logprobs, group):
    """Straight NumPy reading of the scores, including the operand swap of short convolutions."""
    if not logprobs:
        return [0.0, 0.0, math.nan, math.nan, 0.0, 0.0, 0.0]
    conf = -np.array([np.mean(t) if len(t) else np.nan for t in logprobs])
    groups = np.convolve(conf, np.ones(group) / group, mode="valid")
    k = max(1, math.ceil(len(groups) * 0.1))
    low, high = np.partition(groups, k - 1)[:k], np.partition(groups, len(groups) - k)[-k:]
    return [
        groups.mean(), low.mean(), conf[-group:].mean(), conf[:group].mean(), groups.min(),
        high.mean(), groups.max(),
    ]


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 4, 9, 10, 11, 57, 300]
    rows = [[list(map(float, -rng.random(5))) for _ in range(n)] for n in sizes]
    rows.append([[-1.0, -2.0], [], [-3.0]] + [[-0.5]] * 20)
    return rows


def test_all_scores(spark, arrays):
    df = spark.createDataFrame(list(enumerate(arrays)), "i int, logprobs array<array<double>>")
    for group in (3, 10):
        rows = sc.score_responses(df, group).orderBy("i").collect()
        for row, values in zip(rows, arrays):
            np.testing.assert_allclose([row[n] for n in SCORE_NAMES], twin(values, group), rtol=1e-9)


def test_null_and_batch_policy(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [[-1.0]])], "i int, logprobs array<array<float>>")
    zero = sc.score_responses(df, 10).orderBy("i").collect()
    for row in zero[:2]:
        assert row.mean_group_confidence == 0.0 and math.isnan(row.tail_confidence)
    nan = sc.recalculate_confidence(df, 10).orderBy("i").collect()
    assert [r.has_scores for r in nan] == [False, False, True]
    assert all(math.isnan(nan[0][n]) for n in SCORE_NAMES)
    # Ten equal windows would be needed: one value spreads over group - n + 1 groups of sum / group.
    assert nan[2].mean_group_confidence == pytest.approx(0.1)
    assert nan[2].tail_confidence == 1.0
    report = sc.recalculation_report(sc.recalculate_confidence(df, 10)).first()
    assert (report.total, report.valid, report.invalid) == (3, 1, 2)


def test_json_text_is_parsed(spark):
    df = spark.createDataFrame([("[[-1.0,-3.0],[-2.0]]",)], "logprobs string")
    row = sc.recalculate_confidence(df, 1, json_text=True).first()
    assert row.mean_group_confidence == pytest.approx(2.0)


def test_sliding_window_scores_many_batches(spark):
    small = spark.range(25).select(
        F.col("id"), F.transform(F.sequence(F.lit(1), F.col("id") + 1), lambda x: F.array(-x.cast("double"))).alias("logprobs")
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = small.select("id", cf.group_confidence(F.col("logprobs"), 2).alias("g")).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out[0].g == [0.5, 0.5]  # one token, two windows
    assert out[4].g == [1.5, 2.5, 3.5, 4.5]


def test_tumbling(spark):
    values = [1.0, 2.0, 3.0, 4.0, 10.0]
    df = spark.createDataFrame([(values,), ([],), (None,)], "c array<double>")
    rows = df.select(cf.tumbling_confidence(F.col("c"), 2).alias("s")).collect()
    s = rows[0].s
    assert s.mean_group_confidence == pytest.approx((1.5 + 3.5 + 10) / 3)
    assert (s.lowest_group_confidence, s.highest_group_confidence) == (1.5, 10.0)
    assert s.tail_confidence == 7.0 and s.bottom_10_percent_confidence == 1.5
    assert all(v == 0.0 for v in rows[1].s) and all(v == 0.0 for v in rows[2].s)


def test_edge_confidence_matches_scores(spark, arrays):
    df = spark.createDataFrame([(a,) for a in arrays if a], "logprobs array<array<double>>")
    scored = sc.score_responses(df, 10).withColumns(
        {
            "t": cf.edge_confidence(lp.token_confidence(F.col("logprobs")), 10, "tail"),
            "h": cf.edge_confidence(lp.token_confidence(F.col("logprobs")), 10, "head"),
        }
    )
    for r in scored.collect():
        np.testing.assert_allclose([r.t, r.h], [r.tail_confidence, r.head_confidence])


def test_only_missing_columns_are_computed(spark):
    df = spark.createDataFrame([(9.0, [[-1.0]]), (9.0, None)], "tail_confidence double, logprobs array<array<double>>")
    out = sel.ensure_confidence_columns(df, 1).collect()
    assert [r.tail_confidence for r in out] == [9.0, 9.0]
    assert [r.head_confidence for r in out] == [1.0, 0.0]
    tumbling = sel.ensure_confidence_columns(df.drop("tail_confidence"), 1, "tumbling")
    assert "head_confidence" not in tumbling.columns and tumbling.first().tail_confidence == 1.0


def test_score_bounds(spark, arrays):
    df = spark.createDataFrame([(a,) for a in arrays[1:-1]], "logprobs array<array<double>>")
    for r in sc.score_responses(df, 10).collect():
        assert r.lowest_group_confidence <= r.bottom_10_percent_confidence + 1e-12
        assert r.bottom_10_percent_confidence <= r.mean_group_confidence + 1e-12
        assert r.mean_group_confidence <= r.top_10_percent_confidence + 1e-12
        assert r.top_10_percent_confidence <= r.highest_group_confidence + 1e-12


@pytest.mark.parametrize(
    "t_value, df, p",
    # Two-sided critical values of Student's t from published tables.
    [(12.706, 1, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (3.169, 10, 0.01), (1.96, 100000, 0.05)],
)
def test_p_values(t_value, df, p):
    r = t_value / math.sqrt(df + t_value**2)
    got = float(correlation_p(np.array([r]), np.array([df + 2]))[0])
    assert got == pytest.approx(p, rel=2e-3)


def test_p_value_edges():
    got = correlation_p(np.array([0.0, 1.0, 0.5, np.nan]), np.array([10, 10, 2, 10]))
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0
    assert np.isnan(got[2]) and np.isnan(got[3])
