"""Radix selection against NumPy."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voteframe.operators import ordering as o, selection_by_radix as radix

FRACTIONS = [0.0, 0.1, 0.25, 0.5, 0.731, 0.95, 1.0]


def test_integers_keep_the_order_and_bits_of_doubles(spark):
    rng = np.random.default_rng(0)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf")]
    values += [s * 2.0**e * m for e in range(-1030, 1020, 41) for m in (1.0, 1 + 2**-52, 2 - 2**-52) for s in (1, -1)]
    values += list(rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for r in df.select("v", radix.ordered_integer(F.col("v")).alias("i")).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.i == (bits if r.v >= 0 else -bits), r.v
    assert spark.sql("select double('nan') as v").select(radix.ordered_integer(F.col("v"))).first()[0] == 2**63 - 1


@pytest.mark.parametrize("few", [0, 20, 10**6])
@pytest.mark.parametrize("kind", ["wide", "narrow", "ties", "whole", "float"])
def test_percentiles_equal_numpy(spark, monkeypatch, few, kind):
    rng = np.random.default_rng(1)
    n = 700
    values = {
        "wide": rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n), "narrow": np.where(rng.random(n) < 0.02, 1e12 * rng.normal(size=n), 1 + rng.random(n) * 1e-9),
        "ties": rng.integers(0, 3, n) * 0.5 - 0.5, "whole": rng.integers(-(2**62), 2**62, n), "float": rng.normal(size=n).astype(np.float32),
    }[kind]
    monkeypatch.setattr(radix, "FEW", few)
    sql = {"whole": "bigint", "float": "float"}.get(kind, "double")
    df = spark.createDataFrame([(i % 3 if i % 3 else None, v.item()) for i, v in enumerate(values)] + [(7, None)], f"k int, v {sql}").repartition(4)
    got = o.exact_percentiles(df, "v", FRACTIONS).first().percentiles
    # NumPy interpolates differently in the last bits.
    assert got == pytest.approx(np.quantile(values.astype(float), FRACTIONS).tolist(), rel=1e-9)
    keyed = {r.k: r.percentiles for r in o.exact_percentiles(df, "v", FRACTIONS, ["k"], chunk="always").collect()}
    some = {r.k: r.percentiles for r in o.exact_percentiles(df, "v", FRACTIONS, ["k"], hot_rows=233).collect()}
    plain = {r.k: r.percentiles for r in o.exact_percentiles(df, "v", FRACTIONS, ["k"]).collect()}
    assert keyed == some == plain and set(keyed) == {None, 1, 2}
    for k, values_of in keyed.items():
        mine = [float(v) for i, v in enumerate(values) if (i % 3 or None) == k]
        assert values_of == pytest.approx(np.quantile(mine, FRACTIONS).tolist(), rel=1e-9)


def test_weights_count_rows(spark, monkeypatch):
    monkeypatch.setattr(radix, "FEW", 1)
    df = spark.createDataFrame([(1.5, 3), (-2.0, 1), (9.0, 10), (1e-9, 2)], "v double, n long")
    want = np.quantile([1.5] * 3 + [-2.0] + [9.0] * 10 + [1e-9] * 2, FRACTIONS)
    assert o.exact_percentiles(df, "v", FRACTIONS, weight="n").first().percentiles == pytest.approx(want.tolist())


def test_nothing_to_select_from(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert o.exact_percentiles(df, "v", [0.5]).first().percentiles == [None]


def test_a_pass_has_a_bounded_number_of_bins(spark):
    low, high = -(2**63) + 1, 2**63 - 1
    shift = radix.first_shift(low, high)
    assert (high >> shift) - (low >> shift) < 2**radix.BITS <= (high >> (shift - 1)) - (low >> (shift - 1))
