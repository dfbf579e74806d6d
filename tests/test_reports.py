"""Statistics against NumPy and pandas, including oversized groups and degenerate input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voteframe.operators import correlation as co, distributions as di, overlap, within_problem as wp


@pytest.fixture(scope="module")
def graded(spark):
    rng = np.random.default_rng(2)
    n = 1200
    pdf = pd.DataFrame(
        {
            "problem_id": np.where(rng.random(n) < 0.5, "hot", np.char.add("p", rng.integers(0, 60, n).astype(str))),
            "response_idx": np.arange(n),
            "score": np.where(rng.random(n) < 0.2, 1.5, np.round(rng.gamma(2, 2, n), 3)),
            "output_token_count": np.where(rng.random(n) < 0.3, 4000, rng.integers(1, 4000, n)),
            "ok": rng.random(n) < 0.4,
        }
    )
    df = spark.createDataFrame(pdf).cache()
    return df, pdf


def test_spearman_and_pearson(graded):
    df, pdf = graded
    r = co.pearson(df, "score", "ok", with_p=True).first()
    assert r.r == pytest.approx(np.corrcoef(pdf.score, pdf.ok)[0, 1])
    rho = co.spearman(df, "score", "output_token_count", with_p=True).first()
    want = np.corrcoef(pdf.score.rank(), pdf.output_token_count.rank())[0, 1]
    assert (rho.n, rho.rho) == (len(pdf), pytest.approx(want))
    assert 0 <= rho.p_value <= 1


def test_constant_columns_do_not_fail(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, False)], "x double, ok boolean")
    assert co.pearson(df, "x", "ok").first().r is None
    assert co.spearman(df, "x", "ok").first().rho is None
    assert co.correlation_matrix(df.withColumn("t", F.lit(3)), ["x"], "t", "ok").count() == 0
    by = co.per_problem_correlation(df.withColumn("problem_id", F.lit("p")), "x", "ok", with_p=True).first()
    assert (by.r, by.p_value) == (0.0, 1.0)
    grades = spark.createDataFrame([("p", 1.0, True), ("p", 2.0, True)], "problem_id string, x double, ok boolean")
    assert co.per_problem_correlation(grades, "x", "ok").first().r is None


def test_nan_and_null_scores_are_left_out(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (float("nan"), True), (None, True)], "x double, ok boolean")
    assert co.pearson(df, "x", "ok").first().n == 2
    assert di.confidence_by_correctness(df, "x", "ok").first().mean == 1.5


def test_percentile_bins_lose_or_keep_the_maximum(graded):
    df, pdf = graded
    half = di.accuracy_by_percentile(df, "score", "ok", di.ACCURACY_PERCENTILES, False)
    kept = di.accuracy_by_percentile(df, "score", "ok", di.CLOSED_PERCENTILES, True)
    top = int((pdf.score == pdf.score.max()).sum())
    assert half.agg(F.sum("count")).first()[0] == len(pdf) - top
    assert kept.agg(F.sum("count")).first()[0] == len(pdf)
    for r in kept.collect():
        last = r.bin == len(di.CLOSED_PERCENTILES) - 2
        mask = (pdf.score >= r.low) & ((pdf.score <= r.high) if last else (pdf.score < r.high))
        assert (r["count"], r.accuracy) == (mask.sum(), pytest.approx(pdf.ok[mask].mean()))


def test_keyed_bins_match_global_ones(graded):
    df, _ = graded
    one = di.accuracy_by_percentile(df, "score", "ok", di.QUARTILES, True)
    keyed = di.accuracy_by_percentile(df.withColumn("m", F.lit("x")), "score", "ok", di.QUARTILES, True, keys=["m"])
    columns = ["bin", "low", "high", "count", "accuracy"]
    assert sorted(map(tuple, one.select(columns).collect())) == sorted(map(tuple, keyed.select(columns).collect()))


def test_empty_and_constant_input(spark):
    empty = spark.createDataFrame([], "x double, ok boolean")
    assert di.accuracy_by_quantile_bins(empty, "x", "ok").count() == 0
    assert di.describe(empty, "x", (0.9,)).first().n == 0
    constant = spark.createDataFrame([(2.0, True), (2.0, False)], "x double, ok boolean")
    assert di.accuracy_by_quantile_bins(constant, "x", "ok").count() == 0
    histogram = di.confidence_histogram(constant, "x", "ok").collect()
    assert {(r.ok, r.bin, r.share) for r in histogram} == {(True, 0, 1.0), (False, 0, 1.0)}


def test_quantile_bins_cover_all_rows(graded):
    df, pdf = graded
    out = di.accuracy_by_quantile_bins(df, "output_token_count", "ok", ["score"])
    assert out.agg(F.sum("count")).first()[0] == len(pdf)


def test_describe(graded):
    df, pdf = graded
    r = di.describe(df, "score", (0.25, 0.99), sample_std=True).first()
    assert (r.n, r["min"], r["max"]) == (len(pdf), pdf.score.min(), pdf.score.max())
    np.testing.assert_allclose(
        [r.mean, r.median, r["std"], r.p25, r.p99],
        [pdf.score.mean(), pdf.score.median(), pdf.score.std(), pdf.score.quantile(0.25), pdf.score.quantile(0.99)],
    )


@pytest.mark.parametrize("top, expected", [(499.0, 0), (500.0, 1), (1999.0, 1), (2000.0, 2), (9000.0, 2)])
def test_ladder_choice(spark, top, expected):
    assert di.pick_ladder(top, di.CONTENT_LADDER) == di.CONTENT_LADDER[expected][1]
    df = spark.createDataFrame([(0.0,), (10.0,), (top,)], "v double")
    rows = {r.bin: r["count"] for r in di.adaptive_bins(df, "v").collect()}
    edges = di.CONTENT_LADDER[expected][1]
    assert rows == {0: 1, max(i for i, e in enumerate(edges) if e <= top): 1}


@pytest.mark.parametrize("hot", [1_000_000, 25])
def test_median_split(graded, hot):
    df, pdf = graded
    got = wp.within_problem_median_split(df, "score", "ok", hot_rows=hot).first()
    high, low = [], []
    for _, part in pdf.groupby("problem_id"):
        if len(part) < 2:
            continue
        median = part.score.median()
        high.append(part.ok[part.score >= median].mean())
        if (part.score < median).any():
            low.append(part.ok[part.score < median].mean())
    assert (got.high_problems, got.low_problems) == (len(high), len(low))
    np.testing.assert_allclose([got.high_accuracy, got.low_accuracy], [np.mean(high), np.mean(low)])


@pytest.mark.parametrize("hot", [1_000_000, 25])
def test_deciles(graded, hot):
    df, pdf = graded
    got = {r.slice: (r.accuracy, r.problems) for r in wp.within_problem_deciles(df, "output_token_count", "ok", hot_rows=hot).collect()}
    want = {}
    for _, part in pdf.groupby("problem_id"):
        n = len(part)
        if n < 2:
            continue
        ok = part.sort_values(["output_token_count", "response_idx"]).ok.to_numpy()
        for p in wp.SLICES:
            low, high = (0, max(1, int(n * 0.1))) if p == 0 else (int(n * 0.9), n) if p == 100 else (int(n * (p / 100)), int(n * ((p + 10) / 100)))
            if high > low:
                want.setdefault(p, []).append(ok[low:high].mean())
    assert got == {p: (pytest.approx(np.mean(x)), len(x)) for p, x in want.items()}


def test_deltas_sum_to_zero(graded):
    df, _ = graded
    sums = wp.within_problem_deltas(df, "score", "ok").groupBy("problem_id").agg(F.sum("score_delta").alias("s"))
    assert all(abs(r.s) < 1e-6 for r in sums.collect())


def test_truncated_parts(spark):
    df = spark.createDataFrame([(100, True, 5), (99, False, 7)], "t int, is_correct boolean, content_token_count int")
    flagged = di.flag_truncated(df, 100, "t")
    assert [r.truncated for r in flagged.orderBy("t").collect()] == [True, True]
    stats = {r.part: (r.total, r["max"], r.accuracy) for r in di.token_and_accuracy_stats(flagged).collect()}
    assert stats == {"all": (2, 7, 0.5), "kept": (0, 0, 0.0)}


def test_upper_median(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("b", 3), ("b", 9), ("c", 50)], "problem_id string, token_count int")
    r = di.solution_length_report(df, 20).first()
    assert (r.total_problems, r.total_solutions, r.median_tokens, r.max_tokens) == (3, 4, 4, 9)


def test_overlap(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "problem_id string")
    b = spark.createDataFrame([("y",), ("z",)], "problem_id string")
    assert tuple(overlap.key_overlap(a, b).first()) == (2, 2, 1, 1, 1)
    same = overlap.key_overlap(a, a).first()
    assert (same.only_a, same.only_b, same.common) == (0, 0, 2)
