"""The shared ranking against pandas, with gaps, ties and two-valued columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voteframe.operators import correlation as co
from voteframe.operators.pair_correlations import Plan, pair_correlations

COLUMNS = ["a", "b", "c", "const", "one"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 400
    df = pd.DataFrame({"a": rng.normal(size=n).round(1), "b": rng.integers(0, 6, n).astype(float), "c": rng.exponential(size=n) - 0.5})
    df["ok"] = (df.a + rng.normal(size=n) > 0).astype(float)
    df["const"], df["one"] = 3.0, np.nan
    df.loc[rng.random(n) < 0.2, "a"] = np.nan
    df.loc[rng.random(n) < 0.1, "b"] = np.nan
    df.loc[rng.random(n) < 0.3, "ok"] = np.nan
    df.loc[3, "one"] = 1.0
    return df


@pytest.mark.parametrize("two", [["ok"], []])
def test_all_pairs_equal_pandas(spark, frame, two):
    rows = [[None if pd.isna(v) else float(v) for v in r] for r in frame[[*COLUMNS, "ok"]].to_numpy()]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*COLUMNS, "ok"])).repartition(3)
    df = df.withColumn("a", F.when(F.col("a").isNull(), F.lit(float("nan"))).otherwise(F.col("a")))
    pairs = [("a", "ok"), ("b", "ok"), ("ok", "c"), ("a", "b"), ("b", "c"), ("const", "a"), ("one", "a"), ("ok", "ok")]
    got = {(r.x, r.y): r for r in pair_correlations(df, {c: F.col(c) for c in [*COLUMNS, "ok"]}, pairs, two).collect()}
    assert set(got) == set(pairs)
    for x, y in pairs:
        both = pd.DataFrame({"x": frame[x], "y": frame[y]}).dropna()
        r = got[x, y]
        assert r.n == len(both) and r.varied == (both.x.nunique() > 1)
        if both.x.nunique() < 2 or both.y.nunique() < 2:
            assert r.pearson is None and r.spearman is None
        else:
            assert r.pearson == pytest.approx(both.x.corr(both.y)), (x, y)
            assert r.spearman == pytest.approx(both.x.rank().corr(both.y.rank())), (x, y)


def test_columns_are_ranked_once_per_pattern():
    whole = Plan(["a", "b", "ok"], {"ok"}, [("a", "ok"), ("b", "ok"), ("a", "b")], [7])
    assert len(whole.rankings) == 2 and whole.of == [(0, None), (1, None), (0, 1)]
    gaps = Plan(["a", "b", "ok"], {"ok"}, [("a", "ok"), ("b", "ok"), ("a", "b")], [7, 5, 3])
    assert len(gaps.rankings) == 4


def test_matrix_shuffles_do_not_grow_with_the_columns(spark, frame):
    rows = [[float(v) for v in r] for r in frame[["c", "c", "c", "c"]].to_numpy()]
    df = spark.createDataFrame(rows, "s1 double, s2 double, s3 double, t double").withColumn("ok", F.col("s1") > 0)
    plans = [co.correlation_matrix(df, scores, "t", "ok")._jdf.queryExecution().executedPlan().toString() for scores in (["s1"], ["s1", "s2", "s3"])]
    counts = [p.count("Exchange hashpartitioning") for p in plans]
    assert counts[0] == counts[1] and counts[1] < 8


def test_empty_tables(spark):
    df = spark.createDataFrame([], "x double, t int, ok boolean")
    assert co.correlation_matrix(df, ["x"], "t", "ok", with_p=True).count() == 0
    assert co.spearman(df, "x", "ok").first().rho is None
