"""p-values of correlation coefficients as column expressions: Student's t for whole degrees of
freedom.

With s = |r| and c = sqrt(1 - r^2), the probability of a smaller coefficient is a finite sum of powers
of c, and that of a larger one is the rest of the same series, which a continued fraction sums to
full relative precision. Above ``SERIES_UP_TO`` degrees of freedom the statistic is turned into a
normal one by an asymptotic expansion. Everything runs in the JVM, on aggregated rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from voteframe.functions.text import let

#: Degrees of freedom from which the expansion is used; its error there is below 1e-12.
SERIES_UP_TO = 1000
#: Steps of the continued fractions: enough for s from ``NEAR_ZERO`` on, below which the sum is used.
STEPS, NEAR_ZERO = 400, 0.05
#: Where the normal distribution's tail changes from a series to a continued fraction.
FAR = 2.5


def _downward(steps: int, begin: Column, body) -> Column:
    """A continued fraction from its last step to its first."""
    return F.aggregate(F.sequence(F.lit(steps), F.lit(1), F.lit(-1)), begin, lambda g, j: body(g, j.cast("double")))


def partial_series(c2: Column, half: Column, odd: Column) -> Column:
    """``struct<term, sum>``: the first ``half`` terms of the series in c^2, and the term after them."""
    step = lambda state, k: F.struct(
        (state["term"] * (F.lit(2.0) * k - 1 + odd) / (F.lit(2.0) * k + odd) * c2).alias("term"), (state["sum"] + state["term"]).alias("sum")
    )
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    terms = F.when(half > 0, F.sequence(F.lit(1).cast("bigint"), half)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, start, step)


def rest_of_series(c2: Column, half: Column, odd: Column) -> Column:
    """The terms from ``half`` on, divided by the first of them: Gauss's continued fraction of
    2F1(1, b; b + 1/2; c^2)."""
    b = half + (odd + 1) / F.lit(2.0)
    top = b + 0.5

    def body(g: Column, j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        uneven = (b + m) * (top - 1 + m) / ((top + 2 * m - 1) * (top + 2 * m))
        even = m * (m - 0.5) / ((top + 2 * m - 2) * (top + 2 * m - 1))
        return F.lit(1.0) - F.when(j % 2 == 1, uneven).otherwise(even) * c2 / g

    return F.lit(1.0) / _downward(STEPS, F.lit(1.0), body)


def normal_tail(y: Column) -> Column:
    """The probability that a standard normal variable is farther from zero than ``y``."""
    density = F.exp(-y * y / 2) * (2 / math.sqrt(2 * math.pi))
    start = F.struct(y.alias("term"), y.alias("sum"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * y * y / (F.lit(2.0) * k + 1)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    near = F.lit(1.0) - density * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step)["sum"]
    far = density / _downward(100, y, lambda g, j: y + j / g)
    return F.when(y < FAR, near).otherwise(far)


def series_p(s: Column, degrees: Column) -> Column:
    c2 = F.greatest(F.lit(1.0) - s * s, F.lit(0.0))
    odd = (degrees % 2).cast("double")
    half = F.floor(degrees / 2).cast("bigint")
    factor = F.when(odd == 1, F.sqrt(c2) * (2 / math.pi)).otherwise(F.lit(1.0)) * s

    def p(state: Column) -> Column:
        middle = F.when(odd == 1, F.asin(s) * (2 / math.pi)).otherwise(F.lit(0.0)) + factor * state["sum"]
        tail = factor * state["term"] * rest_of_series(c2, half, odd)
        return F.when(s >= NEAR_ZERO, tail).otherwise(F.lit(1.0) - middle)

    return let(partial_series(c2, half, odd), p)


def expanded_p(s: Column, degrees: Column) -> Column:
    """Hill's expansion of a normal statistic with the same p-value. Its numbers are fixed values."""
    a = degrees - 0.5
    b = a * a * 48
    far = F.when(s < 1, -a * F.log1p(-s * s)).otherwise(F.lit(math.inf))

    def statistic(z: Column) -> Column:
        inner = (((z * -0.4 - 3.3) * z - 24.0) * z - 85.5) / (z * z * 0.8 + 100.0 + b)
        return F.when(z < 1e6, ((inner + z + 3.0) / b + 1.0) * F.sqrt(z)).otherwise(F.lit(math.inf))

    return let(let(far, statistic), lambda y: F.when(y < 40, normal_tail(y)).otherwise(F.lit(0.0)))


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation ``r`` over ``n`` pairs; null without ``r`` and for fewer
    than three pairs. For aggregated results."""
    both = F.struct(F.least(F.abs(r.cast("double")), F.lit(1.0)).alias("s"), (n - 2).cast("double").alias("v"))
    p = let(both, lambda x: F.when(x["v"] <= SERIES_UP_TO, series_p(x["s"], x["v"])).otherwise(expanded_p(x["s"], x["v"])))
    return F.when(r.isNotNull() & ~F.isnan(r.cast("double")) & (n > 2), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
