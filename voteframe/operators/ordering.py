"""Ordered computations that stay distributed when one key, or the whole table, is one group.

A window over ``partitionBy(problem)`` puts every row of a problem into one task. Here an oversized
group is cut into chunks by a monotone, row-local function of its order column, so

* inside a chunk an ordinary window numbers or sums the rows, and
* a small table of chunk totals supplies what lies before the chunk.

The chunk of a row depends on its own value and on constants only: at most the smallest and largest
value, which a first job reads (no sampling, no sketches), so a recomputed task always agrees with
the first attempt.

A null key is a group like any other, and a null order value comes first, on both paths: joins on
keys and chunks are null-safe, so what a group's size decides is the plan and never the rows.

``chunk='auto'`` first runs one small job that counts rows per key (combined on the map side). If no
key exceeds ``hot_rows`` the plan is a plain window; otherwise the oversized keys are chunked.
``chunk='always'`` skips the check where groups are known to be few and large, for example one
group per metric or set size; ``chunk='never'`` where no group is oversized. Without keys the whole
table is one group and always chunked. Percentiles of oversized groups are found by radix selection
instead (``selection_by_radix``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voteframe.operators.selection_by_radix import found_in, places, select_places

HOT_ROWS = 1_000_000
FINEST = 8192  # buckets per factor of e on a large cluster
EVEN = 16  # equal buckets of a narrow range, for each bucket per factor of e
_LOG_RANGE = 760  # logarithms of doubles lie within -745 and 710


def resolution(spark: SparkSession) -> int:
    """Buckets per factor of e: a few times the number of shuffle partitions."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(64, min(FINEST, 4 * partitions))


def order_bucket(value: Column, per_efold: int = FINEST) -> Column:
    """Monotone integer bucket of a number: ``per_efold`` buckets per factor of e, on both sides of
    zero."""
    x = value.cast("double")
    log = F.least(F.ln(F.abs(x)), F.lit(710.0))
    size = F.floor(log * per_efold) + F.lit(_LOG_RANGE * per_efold)
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("bigint")


def text_bucket(text: Column, shared: int = 0) -> Column:
    """Monotone bucket of a string: three bytes behind the first ``shared``, which all have alike."""
    head = F.hex(F.substring(F.encode(text, "UTF-8"), shared + 1, 3))
    return F.conv(F.rpad(head, 6, "0"), 16, 10).cast("bigint")


def even_bucket(value: Column, low: float, high: float, buckets: int) -> Column:
    """Monotone bucket of a number between ``low`` and ``high``: parts of equal width."""
    return F.floor((value.cast("double") - F.lit(low)) * F.lit(buckets / (high - low))).cast("bigint")


def type_bucket(df: DataFrame, order: str) -> Column:
    """The bucket that fits the type of the order column."""
    if dict(df.dtypes)[order] == "string":
        return text_bucket(F.col(order))
    return order_bucket(_number(df, order), resolution(df.sparkSession))


def fitted_bucket(df: DataFrame, order: str) -> Column:
    """The bucket that fits the type and the range of the order column (runs one small job).

    Whatever lies between two texts begins with what these two have in common, so texts are told
    apart behind the common beginning of the smallest and the largest. Numbers farther from zero
    than from each other (ids with an offset, times) get buckets of equal width.
    """
    if dict(df.dtypes)[order] == "string":
        ends = df.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
        both = [(t or "").encode() for t in (ends.low, ends.high)]
        return text_bucket(F.col(order), len(commonprefix(both)))
    number, parts = _number(df, order), resolution(df.sparkSession)
    ends = df.agg(F.min(number.cast("double")).alias("low"), F.max(number.cast("double")).alias("high")).first()
    finite = ends.low is not None and math.isfinite(ends.low) and math.isfinite(ends.high)
    if finite and 0 < ends.high - ends.low <= min(abs(ends.low), abs(ends.high)):
        return even_bucket(number, ends.low, ends.high, EVEN * parts)
    return order_bucket(number, parts)


def _number(df: DataFrame, order: str) -> Column:
    return F.unix_date(order) if dict(df.dtypes)[order] == "date" else F.col(order)


def hash_bucket(df: DataFrame, digest: str) -> Column:
    """Monotone bucket of a hexadecimal digest: its first two to four digits."""
    buckets = resolution(df.sparkSession)
    digits = 2 if buckets <= 256 else 3 if buckets <= 4096 else 4
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def sample_key(*parts: Column | str, seed: int = 42) -> Column:
    """Reproducible random order: the digest of the key and the seed."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed))))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; the keys of the left side stay."""
    names = {k: f"__right_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def oversized(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, or None if there are none (runs one counting job)."""
    hot = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
        .where(F.col("__rows") > hot_rows).select(*keys)
    )
    return None if hot.isEmpty() else hot


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: dict[str, Column],
    bucket: Column | None = None,
    hot_rows: int = HOT_ROWS,
    chunk: str = "auto",
    totals: bool = False,
) -> DataFrame:
    """Add, per key, the sum of each measure over all rows that come before the row, and with
    ``totals`` its sum over the whole key as ``<name>_total``.

    ``order`` must be unique within a key. Without keys the whole table is one ordered group.
    """
    keys = list(keys)
    before = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    if keys and chunk in ("auto", "never"):
        hot = oversized(df, keys, hot_rows) if chunk == "auto" else None
        if hot is None:
            w = before(*keys).orderBy(order)
            added = {n: F.coalesce(F.sum(c).over(w), zero) for n, c in measures.items()}
            if totals:
                whole = Window.partitionBy(*keys)
                added |= {f"{n}_total": F.sum(c).over(whole) for n, c in measures.items()}
            return df.withColumns(added)
        flagged = null_safe_join(df, hot.withColumn("__hot", F.lit(True)), keys, "left")
        bucket = fitted_bucket(df, order) if bucket is None else bucket
        place = F.when(F.col("__hot"), bucket).otherwise(F.lit(0).cast("bigint"))
    else:
        flagged, place = df, fitted_bucket(df, order) if bucket is None else bucket
    names = {name: f"__m{i}" for i, name in enumerate(measures)}
    cut = flagged.withColumns({names[n]: c for n, c in measures.items()} | {"__chunk": place})
    # One row per chunk: at most a few hundred thousand per group, however large the group is.
    sums = cut.groupBy(*keys, "__chunk").agg(*[F.sum(c).alias(c) for c in names.values()])
    ahead, whole = before(*keys).orderBy("__chunk"), Window.partitionBy(*keys)
    offsets = sums.select(
        *keys, "__chunk",
        *[F.coalesce(F.sum(c).over(ahead), zero).alias(f"{c}_off") for c in names.values()],
        *[F.sum(c).over(whole).alias(f"{n}_total") for n, c in names.items() if totals],
    )
    local = before(*keys, "__chunk").orderBy(order)
    joined = null_safe_join(cut, offsets, [*keys, "__chunk"])
    for name, c in names.items():
        inside = F.coalesce(F.sum(c).over(local), zero)
        joined = joined.withColumn(name, F.col(f"{c}_off") + inside)
    return joined.select(*df.columns, *names, *[f"{n}_total" for n in names if totals])


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str = "row_no",
    bucket: Column | None = None,
    hot_rows: int = HOT_ROWS,
    chunk: str = "auto",
) -> DataFrame:
    """Zero-based position of each row within its key; ``order`` must be unique within a key."""
    one = {name: F.lit(1).cast("bigint")}
    return running_totals(df, keys, order, one, bucket, hot_rows, chunk)


def with_positions(
    df: DataFrame, keys: Sequence[str], order: str, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the zero-based position of each row within its key, whatever gaps a filter left in
    ``order``, which should be unique within a key. One job with map-side combine looks for gaps and
    repeats; where there are none, ``order`` is the position and nothing is shuffled. Repeated
    values take positions one after another, in any order.

    A key is dense if its values have the number, the ends, the sum and the sum of squares of
    ``0 .. n-1``. Doubles hold both sums exactly below 2**53; beyond, a key is not called dense.
    """
    n, x = F.count(F.lit(1)), F.col(order).cast("double")
    size = n.cast("double")
    squares = F.sum(x * x)
    dense = (
        (F.count(order) == n) & (F.min(order) == 0) & (F.max(order) == n - 1)
        & (F.sum(x) == size * (size - 1) / 2) & (squares < 2.0**53)
        & (squares * 6 == size * (size - 1) * (2 * size - 1))
    )
    if df.groupBy(*keys).agg(dense.alias("__dense")).where(~F.col("__dense")).isEmpty():
        return df.withColumn(name, F.col(order).cast("bigint"))
    return row_numbers(df, keys, order, name, hot_rows=hot_rows)


def hash_row_numbers(
    df: DataFrame, keys: Sequence[str], digest: str, name: str = "row_no", hot_rows: int = HOT_ROWS,
    chunk: str = "auto",
) -> DataFrame:
    """Zero-based position in digest order."""
    return row_numbers(df, keys, digest, name, hash_bucket(df, digest), hot_rows, chunk)


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: str,
    name: str = "row_no",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Zero-based position ordered by ``value`` and then by ``tie`` (unique within key and value).

    With an oversized key, equal values may be as many as a third of the table, so values are
    counted first and equal ones are numbered among themselves separately.
    """
    if oversized(df, keys, hot_rows) is None:
        w = Window.partitionBy(*keys).orderBy(value, tie)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    cells = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    placed = running_totals(cells, keys, value, {"__below": F.col("__n")}, hot_rows=hot_rows)
    inside = row_numbers(df, [*keys, value], tie, "__inside", hot_rows=hot_rows)
    return (
        null_safe_join(inside, placed.drop("__n"), [*keys, value])
        .withColumn(name, F.col("__below") + F.col("__inside"))
        .select(*df.columns, name)
    )


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, hot_rows: int = HOT_ROWS, chunk: str = "auto",
    weight: str | None = None,
) -> DataFrame:
    """Distinct non-null values per key: ``__n`` rows, ``__below`` rows under it, ``__below_total``
    rows of the key. ``weight`` names a column of counts if the input is already counted."""
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(rows.alias("__n"))
    below = {"__below": F.col("__n")}
    return running_totals(cells, keys, value, below, type_bucket(cells, value), hot_rows, chunk, totals=True)


def exact_percentiles(
    df: DataFrame,
    value: str,
    fractions: Sequence[float],
    keys: Sequence[str] = (),
    name: str = "percentiles",
    hot_rows: int = HOT_ROWS,
    chunk: str = "auto",
    weight: str | None = None,
    few: int | None = None,
) -> DataFrame:
    """Array of linearly interpolated percentiles per key (one row in all without keys).

    Exact, and without holding a group's values in one buffer. Groups of up to ``hot_rows`` rows are
    read off their counted distinct values in a window; larger ones, and a whole table, by radix selection.
    ``weight`` names a column of counts if the input is already counted; ``few`` is the number of rows up to which radix
    selection tells all values apart in one pass.
    """
    keys = list(keys)
    if not keys or chunk == "always":
        return _interpolated(select_places(df, value, fractions, keys, weight, few), fractions, keys, name)
    hot = oversized(df, keys, hot_rows)
    if hot is None:
        return _window_percentiles(df, value, fractions, keys, name, weight)
    large, rest = (null_safe_join(df, hot, keys, how) for how in ("left_semi", "left_anti"))
    found = _interpolated(select_places(large, value, fractions, keys, weight, few), fractions, keys, name)
    return found.unionByName(_window_percentiles(rest, value, fractions, keys, name, weight))


def _interpolated(picked: DataFrame, fractions: Sequence[float], keys: list[str], name: str) -> DataFrame:
    last = F.max("__total") - F.lit(1)
    at = [F.max(F.when(F.col("__t") == t, F.col("__value"))).alias(f"__v{t}") for t in range(2 * len(fractions))]
    rows = picked.groupBy(*keys).agg(*at, F.array(*[last * F.lit(float(f)) for f in fractions]).alias("__place"))
    return rows.select(*keys, F.array(*[
        F.col(f"__v{2 * i}") + (F.col(f"__v{2 * i + 1}") - F.col(f"__v{2 * i}")) * (F.col("__place")[i] - F.floor(F.col("__place")[i]))
        for i in range(len(fractions))
    ]).alias(name))


def _window_percentiles(
    df: DataFrame, value: str, fractions: Sequence[float], keys: list[str], name: str, weight: str | None
) -> DataFrame:
    """The two neighbouring order statistics of each fraction among the counted distinct values."""
    cells = value_counts(df, keys, value, chunk="never", weight=weight)
    inside = found_in(cells, places(F.col("__below_total"), fractions))
    picked = inside.select(
        *keys, F.col(value).cast("double").alias("__value"), F.col("__below_total").alias("__total"), F.explode("__found").alias("p")
    )
    return _interpolated(picked.withColumn("__t", F.col("p.t")), fractions, keys, name)


def average_ranks(
    df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "rank",
    hot_rows: int = HOT_ROWS, chunk: str = "auto", weight: str | None = None,
) -> DataFrame:
    """Per distinct value: its average rank minus the mean rank, so ranks are centred on zero."""
    cells = value_counts(df, keys, value, hot_rows, chunk, weight)
    middle = F.col("__below") + (F.col("__n") + 1) / F.lit(2.0)
    return cells.select(
        *keys, value, (middle - (F.col("__below_total") + 1) / F.lit(2.0)).alias(name)
    )


def constant_bin(value: Column, edges: Sequence[float], closed_last: bool) -> Column:
    """Zero-based bin of ``value`` among constant edges; null outside. Bins are ``[low, high)``;
    with ``closed_last`` the last one also takes the maximum. A chain of comparisons, compiled."""
    last = len(edges) - 2
    top = (value == F.lit(edges[-1])) if closed_last else F.lit(False)
    chain = F.when(top, F.lit(last)).when(value >= F.lit(edges[-1]), F.lit(None).cast("int"))
    for i in range(last, -1, -1):
        chain = chain.when(value >= F.lit(edges[i]), F.lit(i))
    return chain


def bin_index(value: Column, edges: Column, closed_last: bool) -> Column:
    """Zero-based bin of ``value`` among ``edges``; null outside. Bins are ``[low, high)``; with
    ``closed_last`` the last one also takes the maximum."""
    reached = F.size(F.filter(edges, lambda e: e <= value))
    bins = F.size(edges) - F.lit(1)
    top = F.when(F.lit(closed_last) & (value == F.element_at(edges, -1)), bins - F.lit(1))
    inside = (reached > 0) & (reached <= bins)
    return F.when(inside, reached - F.lit(1)).otherwise(top)
