"""Ordered primitives, with and without the chunked path, against NumPy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voteframe.operators import ordering as o

HOT = [1_000_000, 20]  # plain windows, and chunks for every key above 20 rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values are negative, zero, tied and heavy-tailed."""
    rng = np.random.default_rng(7)
    n = 900
    keys = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcde"), n))
    values = np.where(rng.random(n) < 0.3, 5.0, np.round(rng.standard_cauchy(n), 2))
    values[:5] = [0.0, -1e-9, 1e12, -1e12, 1e-9]
    pdf = pd.DataFrame({"k": keys, "i": np.arange(n), "v": values, "w": rng.integers(1, 9, n)})
    df = spark.createDataFrame(pdf).repartition(4).cache()
    df.count()
    return df, pdf


@pytest.mark.parametrize("hot", HOT)
def test_row_numbers(skewed, hot):
    df, pdf = skewed
    got = {r.i: r.row_no for r in o.row_numbers(df, ["k"], "i", hot_rows=hot).collect()}
    want = pdf.sort_values("i").groupby("k").cumcount()
    assert got == dict(zip(pdf.i, want))


def test_global_row_numbers(skewed):
    df, pdf = skewed
    got = {r.i: r.row_no for r in o.row_numbers(df, [], "i").collect()}
    assert got == {i: i for i in pdf.i}


@pytest.mark.parametrize("hot", HOT)
def test_running_totals(skewed, hot):
    df, pdf = skewed
    out = o.running_totals(df, ["k"], "i", {"s": F.col("w")}, hot_rows=hot, totals=True)
    got = {r.i: (r.s, r.s_total) for r in out.collect()}
    sums = pdf.groupby("k").w.cumsum() - pdf.w
    totals = pdf.groupby("k").w.transform("sum")
    assert got == {i: (s, t) for i, s, t in zip(pdf.i, sums, totals)}


@pytest.mark.parametrize("hot", HOT)
def test_hash_row_numbers(skewed, hot):
    df, pdf = skewed
    keyed = df.withColumn("d", o.sample_key("i"))
    rows = o.hash_row_numbers(keyed, ["k"], "d", hot_rows=hot).toPandas()
    for _, part in rows.groupby("k"):
        assert list(part.sort_values("d").row_no) == list(range(len(part)))


@pytest.mark.parametrize("hot", HOT)
def test_ranked_breaks_ties_by_the_second_column(skewed, hot):
    df, pdf = skewed
    got = {r.i: r.row_no for r in o.ranked(df, ["k"], "v", "i", hot_rows=hot).collect()}
    ordered = pdf.sort_values(["k", "v", "i"])
    assert got == dict(zip(ordered.i, ordered.groupby("k").cumcount()))


@pytest.mark.parametrize("hot", HOT)
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_exact_percentiles(skewed, hot, keys):
    df, pdf = skewed
    fractions = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    out = o.exact_percentiles(df, "v", fractions, keys, hot_rows=hot).collect()
    groups = {None: pdf} if not keys else dict(list(pdf.groupby("k")))
    assert len(out) == len(groups)
    for r in out:
        want = np.percentile(groups[r.k if keys else None].v, [f * 100 for f in fractions])
        np.testing.assert_allclose(r.percentiles, want, rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("chunk", ["auto", "always"])
def test_average_ranks(skewed, chunk):
    df, pdf = skewed
    got = {(r.k, r.v): r["rank"] for r in o.average_ranks(df, "v", ["k"], chunk=chunk).collect()}
    ranks = pdf.groupby("k").v.rank()
    centred = ranks - (pdf.groupby("k").v.transform("size") + 1) / 2
    assert got == {(k, v): c for k, v, c in zip(pdf.k, pdf.v, centred)}


def test_order_bucket_is_monotone(spark):
    values = sorted([-1e300, -5.0, -1.0001, -1.0, -1e-300, 0.0, 1e-300, 0.3, 1.0, 1.0001, 2.0, 1e17, 1e300, float("inf")])
    df = spark.createDataFrame([(v,) for v in values], "v double").select(o.order_bucket(F.col("v")).alias("b"))
    buckets = [r.b for r in df.collect()]
    assert buckets == sorted(buckets)


def test_bins_half_open_and_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4]], "v double")
    edges = [0.0, 2.0, 4.0]
    array = F.array(*[F.lit(e) for e in edges])
    for closed, last in ((False, None), (True, 1)):
        row = [
            (r.a, r.b)
            for r in df.select(
                o.bin_index(F.col("v"), array, closed).alias("a"),
                o.constant_bin(F.col("v"), edges, closed).alias("b"),
            ).collect()
        ]
        assert row == [(x, x) for x in (0, 0, 1, 1, last)]


@pytest.mark.parametrize("hot", HOT)
def test_text_order(spark, hot):
    texts = ["", "a", "ab", "abc", "abcd", "abce", "b", "é", "z", "日本", "日月", "\U0001f600"] + [f"k{i:03}" for i in range(40)]
    df = spark.createDataFrame([("k", t) for t in texts], "k string, t string")
    for keys in (["k"], []):
        got = {r.t: r.row_no for r in o.row_numbers(df, keys, "t", hot_rows=hot).collect()}
        assert got == {t: i for i, t in enumerate(sorted(texts, key=lambda x: x.encode()))}


def test_date_order(spark):
    df = spark.sql("select date '1960-05-01' d union all select date '2020-01-01' union all select date '1970-01-01'")
    got = [r.row_no for r in o.row_numbers(df, [], "d").orderBy("d").collect()]
    assert got == [0, 1, 2]


@pytest.mark.parametrize("kind", ["offset", "prefix"])
def test_chunks_are_even_for_offsets_and_shared_prefixes(spark, kind):
    ids = spark.range(10_000)
    v = F.col("id") + F.lit(10**12) if kind == "offset" else F.format_string("gsm8k_%05d", "id")
    df = ids.select("id", v.alias("v"))
    rows = [r["count"] for r in df.groupBy(o.fitted_bucket(df, "v").alias("b")).count().collect()]
    assert len(rows) >= 100 and max(rows) <= 2 * 10_000 / len(rows)
    got = {r.id: r.row_no for r in o.row_numbers(df, [], "v").collect()}
    assert got == {i: i for i in range(10_000)}


@pytest.mark.parametrize("values", [[7.0], [], [None, None], [-1e12, -1e12 - 5], [1e12, float("inf")], [1e12, float("nan"), None]])
def test_ranges_without_width_or_end(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert sorted(r.row_no for r in o.row_numbers(df, [], "v").collect()) == list(range(len(values)))
