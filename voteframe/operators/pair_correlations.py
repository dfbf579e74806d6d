"""Pearson and Spearman coefficients of many pairs of columns from one shared ranking.

A column's ranks depend on which rows take part, and these are the rows where both columns of a pair
are present. Rows are told apart by the set of columns they have (their pattern); a column is ranked
once for each different set of patterns that its pairs ask for, which is once if no column has gaps.
All columns are ranked together, as counted values in one long table.

A column of two values (a grade) is never ranked: its centred ranks are two constants, so a pair
with it needs only the sum of the other column's ranks over the rows of one value, which the counted
values hold. For other pairs the ranks meet again by row, all pairs in one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voteframe.operators.ordering import running_totals, type_bucket
from voteframe.session import cut_lineage


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson coefficient as an aggregate; null instead of an error for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    sx, sy = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    varied = (F.min(F.when(both, x)) < F.max(F.when(both, x))) & (
        F.min(F.when(both, y)) < F.max(F.when(both, y))
    )
    return F.when(varied, F.try_divide(F.covar_pop(x, y), sx * sy))


def centred_ranks(cells: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """``keys, value, __rank``: average ranks, less their mean, of counted distinct values."""
    below = running_totals(
        cells, keys, value, {"__below": F.col(count)}, type_bucket(cells, value), chunk="always", totals=True
    )
    rank = F.col("__below") + F.col(count) / F.lit(2.0) - F.col("__below_total") / F.lit(2.0)
    return below.withColumn("__rank", rank).drop("__below", "__below_total")


def rho(products: Column, squares: Column, others: Column) -> Column:
    scale = F.sqrt(squares) * F.sqrt(others)
    return F.when(scale > 0, F.try_divide(products, scale))


def two_valued_rho(n: Column, ones: Column, sum_of_ones: Column, squares: Column) -> Column:
    """Of ranks and a column of n rows with ``ones`` ones: the ones' centred rank lies ``n / 2`` above
    the zeros', and both together have mean zero."""
    size, high = n.cast("double"), ones.cast("double")
    return rho(size / 2 * sum_of_ones, squares, size * high * (size - high) / 4)


class Plan:
    """Which patterns each pair reads, and the rankings that the pairs share."""

    def __init__(self, names: list[str], two: set[str], pairs: list[tuple[str, str]], patterns: list[int]) -> None:
        self.pairs, self.two = pairs, two
        bit = {name: 1 << i for i, name in enumerate(names)}
        self.rankings: dict[tuple[str, tuple[int, ...]], int] = {}
        self.of: list[tuple[int | None, int | None]] = []
        for x, y in pairs:
            rows = tuple(p for p in patterns if p & bit[x] and p & bit[y])
            self.of.append(tuple(
                None if c in two else self.rankings.setdefault((c, rows), len(self.rankings)) for c in (x, y)
            ))


def pair_correlations(
    df: DataFrame, columns: dict[str, Column], pairs: Sequence[tuple[str, str]], two_valued: Sequence[str] = ()
) -> DataFrame:
    """``x, y, n, varied, pearson, spearman`` for each pair of names in ``columns``.

    ``n`` counts the rows where both are present (not null, not NaN), ``varied`` tells whether x differs in
    them. ``two_valued`` names columns of zeros and ones. A coefficient is null for a constant
    column. Starts jobs: the columns are written once, and the patterns of present columns (at most
    two to the number of columns) are counted.
    """
    names = list(columns)
    values = {n: c.cast("double") for n, c in columns.items()}
    slim = df.select(*[F.when(~F.isnan(c), c).alias(n) for n, c in values.items()])
    held = sum((F.when(F.col(n).isNotNull(), F.lit(1 << i)).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    # Numbers of rows as written, the same whenever they are read.
    base = cut_lineage(slim.select("*", held.alias("__has"), F.monotonically_increasing_id().alias("__row")), "columns")
    patterns = sorted(r["__has"] for r in base.select("__has").distinct().collect())
    plan = Plan(names, set(two_valued), list(pairs), patterns)

    def pearson_of(x: str, y: str) -> Column:
        a, b = F.col(x), F.col(y)
        both = a.isNotNull() & b.isNotNull()
        return F.struct(
            F.lit(x).alias("x"), F.lit(y).alias("y"), F.count_if(both).alias("n"),
            F.coalesce(F.min(F.when(both, a)) < F.max(F.when(both, a)), F.lit(False)).alias("varied"), safe_corr(a, b).alias("pearson"),
        )

    figures = base.agg(F.array(*[pearson_of(x, y) for x, y in plan.pairs]).alias("all")).select(F.inline("all"))
    ranks = rank_figures(base, plan)
    if ranks is None:
        ranked = figures.withColumn("spearman", F.lit(None).cast("double"))
    else:
        ranked = figures.join(ranks, ["x", "y"], "left")
    marks = F.col("x").isin(list(plan.two)) & F.col("y").isin(list(plan.two))  # ranks of two values are linear in them
    return ranked.withColumn("spearman", F.when(marks, F.col("pearson")).otherwise(F.col("spearman"))) if plan.two else ranked


def rank_figures(base: DataFrame, plan: Plan) -> DataFrame | None:
    if not plan.rankings:
        return None
    marks = sorted(plan.two)
    entry = lambda name, rows, k: F.when(
        F.col("__has").isin(list(rows)), F.struct(F.lit(k).alias("k"), F.col(name).alias("v")))
    listed = [entry(name, rows, k) for (name, rows), k in plan.rankings.items() if rows]
    if not listed:
        return None
    long = base.select("__row", *marks, F.explode(F.array_compact(F.array(*listed))).alias("e")).select("__row", *marks, "e.*")
    cells = long.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).cast("double").alias(m) for m in marks])
    ranked = cut_lineage(centred_ranks(cut_lineage(cells, "cells"), ["k"], "v", "n"), "ranks")
    rank, parts = F.col("__rank"), []
    graded = [(i, k, y) for i, ((_, y), (k, _)) in enumerate(zip(plan.pairs, plan.of)) if y in plan.two and k is not None]
    graded += [(i, k, x) for i, ((x, _), (_, k)) in enumerate(zip(plan.pairs, plan.of)) if x in plan.two and k is not None]
    if graded:
        sums = ranked.groupBy("k").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * rank * rank).alias("squares"),
            *[F.sum(m).alias(m) for m in marks], *[F.sum(F.col(m) * rank).alias(f"{m}__ranks") for m in marks],
        )
        rows = [
            F.when(F.col("k") == k, F.struct(
                F.lit(plan.pairs[i][0]).alias("x"), F.lit(plan.pairs[i][1]).alias("y"),
                two_valued_rho(F.col("n"), F.col(m), F.col(f"{m}__ranks"), F.col("squares")).alias("spearman"),
            )) for i, k, m in graded
        ]
        parts.append(sums.select(F.inline(F.array_compact(F.array(*rows)))))
    free = [(x, y, a, b) for (x, y), (a, b) in zip(plan.pairs, plan.of) if a is not None and b is not None]
    if free:
        needed = sorted({k for *_, a, b in free for k in (a, b)})
        placed = long.where(F.col("k").isin(needed)).select("__row", "k", "v").join(ranked.select("k", "v", "__rank"), ["k", "v"])
        wide = placed.groupBy("__row").agg(*[F.max(F.when(F.col("k") == k, rank)).alias(f"r{k}") for k in needed])
        sums = wide.agg(
            *[F.sum(F.col(f"r{k}") * F.col(f"r{k}")).alias(f"s{k}") for k in needed],
            *[F.sum(F.col(f"r{a}") * F.col(f"r{b}")).alias(f"p{i}") for i, (*_, a, b) in enumerate(free)],
        )
        rows = [
            F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), rho(F.col(f"p{i}"), F.col(f"s{a}"), F.col(f"s{b}")).alias("spearman"))
            for i, (x, y, a, b) in enumerate(free)
        ]
        parts.append(sums.select(F.inline(F.array(*rows))))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
