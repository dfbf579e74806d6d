"""Exact order statistics by radix selection.

A number becomes a 64-bit integer of the same order: an integer itself, a double its sign, exponent
and mantissa. Passes over the rows narrow each wanted place to one value: a pass counts rows per bin,
a bin being all integers with the same leading bits, and only the bin that holds the place is
looked into by the next pass, with more bits. However values are spread, a pass has at most
``2**BITS`` bins per group or opened bin, counted on the map side, and no window or sort holds the values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voteframe.session import cut_lineage

BITS = 14
#: Rows of a bin from which the next pass tells all values apart.
FEW = 100_000
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def ordered_integer(value: Column) -> Column:
    """The 64-bit integer of a double, in the order of doubles: infinities outside, NaN last. Made by
    arithmetic that is exact: scaling by powers of two."""
    x = value.cast("double")
    size = F.abs(x)
    near = F.floor(F.log2(size)).cast("int")  # may be off by one beside a power of two
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    exponent = F.when(size < power(near), near - 1).when(size >= power(near + 1), near + 1).otherwise(near)
    mantissa = ((size / power(exponent) - 1) * F.lit(2.0**52)).cast("bigint")
    normal = (exponent + 1023).cast("bigint") * F.lit(1 << 52) + mantissa
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    whole = (
        F.when(F.isnan(x), F.lit(2**63 - 1)).when(size == float("inf"), F.lit(2047 << 52))
        .when(size < F.lit(2.0**-1022), tiny).otherwise(normal)
    )
    return F.when((x < 0) & ~F.isnan(x), -whole).otherwise(whole)


def integer_of(df: DataFrame, value: str) -> Column:
    kind = dict(df.dtypes)[value]
    if kind == "date":
        return F.unix_date(value).cast("bigint")
    return F.col(value).cast("bigint") if kind in _WHOLE else ordered_integer(F.col(value))


def places(total: Column, fractions: Sequence[float]) -> Column:
    """``array<struct<t, at>>``: the two neighbouring places of each fraction, numbered in turn."""
    last = total - F.lit(1)
    listed = []
    for i, fraction in enumerate(fractions):
        place = last * F.lit(float(fraction))
        listed += [(2 * i, F.floor(place)), (2 * i + 1, F.ceil(place))]
    return F.array(*[F.struct(F.lit(t).alias("t"), at.cast("bigint").alias("at")) for t, at in listed])


def found_in(bins: DataFrame, wanted: Column) -> DataFrame:
    """The wanted places that lie in a bin of ``__n`` rows behind ``__below`` others, and how far
    behind the bin's first row."""
    inside = F.filter(wanted, lambda p: (F.col("__below") <= p["at"]) & (p["at"] < F.col("__below") + F.col("__n")))
    found = F.transform(inside, lambda p: F.struct(p["t"].alias("t"), (p["at"] - F.col("__below")).alias("at")))
    return bins.withColumn("__found", found).where(F.size("__found") > 0)


def select_places(
    df: DataFrame, value: str, fractions: Sequence[float], keys: Sequence[str] = (), weight: str | None = None,
    few: int | None = None,
) -> DataFrame:
    """``keys, __t, __value, __total``: for each fraction of each group the values at its two neighbouring places
    (numbers 2i and 2i + 1) in the order of ``value``, and the rows of the group. Null values are left
    out; a null key is a group. ``few`` replaces ``FEW``. Starts jobs: one write of the columns, one for their ends and sizes, and one per pass."""
    from voteframe.operators.ordering import null_safe_join

    keys, few = list(keys), FEW if few is None else few
    n = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    rows = df.where(F.col(value).isNotNull())
    rows = rows.select(*keys, F.col(value).cast("double").alias("__value"), integer_of(df, value).alias("__int"), n.alias("__n"))
    rows = cut_lineage(rows, "values")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min("__int").alias("low"), F.max("__int").alias("high"))
    ends = sizes.agg(F.max("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    shift = 0 if ends.low is None or ends.c <= few else first_shift(ends.low, ends.high)
    bins = counted(rows, keys, shift)
    order = Window.partitionBy(*keys).orderBy("__bin")
    below = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("__n").over(Window.partitionBy(*keys))
    state = found_in(bins.withColumns({"__below": below, "__total": total}), places(F.col("__total"), fractions))
    while shift:
        state = cut_lineage(state.select(*keys, F.col("__bin").alias("__open"), "__c", "__total", "__found"), "places")
        most, before = state.agg(F.max("__c")).first()[0], shift
        shift = 0 if most <= few else max(0, shift - BITS)
        # At most two bins per fraction of a group are open.
        opened = rows.withColumn("__open", F.expr(f"shiftright(__int, {before})"))
        opened = null_safe_join(opened, state.select(*keys, "__open"), [*keys, "__open"], "left_semi")
        bins = counted(opened, [*keys, "__open"], shift)
        order = Window.partitionBy(*keys, "__open").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("__below", F.coalesce(F.sum("__n").over(order), F.lit(0)))
        wanted = state.select(*keys, "__open", "__total", F.col("__found").alias("__wanted"))
        state = found_in(null_safe_join(bins, wanted, [*keys, "__open"]), F.col("__wanted"))
    return state.select(*keys, "__value", "__total", F.explode("__found").alias("p")).select(
        *keys, F.col("p.t").alias("__t"), "__value", "__total"
    )


def first_shift(low: int, high: int) -> int:
    """The fewest bits to leave out so that the ends are less than ``2**BITS`` bins apart."""
    shift = 0
    while (high >> shift) - (low >> shift) >= 1 << BITS:
        shift += 1
    return shift


def counted(rows: DataFrame, keys: Sequence[str], shift: int) -> DataFrame:
    """Bins with their rows (``__n``, by weight; ``__c``, as stored). Without a shift a bin is one value."""
    return rows.groupBy(*keys, F.expr(f"shiftright(__int, {shift})").alias("__bin")).agg(
        F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__c"), F.min("__value").alias("__value")
    )
