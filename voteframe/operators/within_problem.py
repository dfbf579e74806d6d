"""Analyses that compare the responses of a problem with each other.

Every report starts from counts per (problem, value), joined with per-problem aggregates; no window
holds a whole oversized problem. Reports that pass over their rows several times first write the few
columns they need to the shared folder. Rows without a problem have nothing to be compared with and
are left out of all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from voteframe.functions.probability import p_value
from voteframe.operators.distributions import QUARTILES, accuracy_by_percentile, present
from voteframe.operators.ordering import HOT_ROWS, exact_percentiles, ranked
from voteframe.operators.pair_correlations import pair_correlations
from voteframe.session import cut_lineage

# Starting percents of the slices.
SLICES = (0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100)


def comparable(df: DataFrame, columns: Sequence[str], key: str = "problem_id") -> DataFrame:
    """Rows with every column present, of problems that keep at least two such rows."""
    rows = df
    for c in columns:
        rows = rows.where(present(c))
    enough = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= 2)
    return rows.join(enough.select(key), key, "left_semi")


def within_problem_deltas(
    df: DataFrame, score: str, correct: str, tokens: str = "output_token_count",
    key: str = "problem_id",
) -> DataFrame:
    """Score and token difference of each response from its problem's means."""
    rows = df.where(present(score) & present(tokens) & F.col(correct).isNotNull())
    means = rows.groupBy(key).agg(
        F.avg(score).alias("__score"), F.avg(tokens).alias("__tokens"),
        F.count(F.lit(1)).alias("__n"),
    ).where(F.col("__n") >= 2)
    joined = rows.join(means, key)
    return joined.withColumns(
        {
            "score_delta": F.col(score) - F.col("__score"),
            "token_delta": F.col(tokens) - F.col("__tokens"),
        }
    ).drop("__score", "__tokens", "__n")


def delta_correlations(deltas: DataFrame, correct: str, with_p: bool = False) -> DataFrame:
    """Pearson and Spearman of score delta, token delta and correctness, pair by pair, from one
    ranking of both deltas."""
    columns = {"score_delta": F.col("score_delta"), "token_delta": F.col("token_delta"), "correct": F.col(correct)}
    pairs = [("score_delta", "correct"), ("token_delta", "correct"), ("score_delta", "token_delta")]
    two = ["correct"] if dict(deltas.dtypes)[correct] == "boolean" else []
    found = pair_correlations(deltas, columns, pairs, two)
    r, rho, n = F.col("pearson"), F.col("spearman"), F.col("n")
    shown = [F.concat_ws("_vs_", "x", "y").alias("pair"), n, r.alias("r"), rho.alias("rho")]
    if with_p:
        shown[3:3] = [p_value(r, n).alias("r_p")]
        shown += [p_value(rho, n).alias("rho_p")]
    return found.select(*shown)


def delta_quartile_accuracy(deltas: DataFrame, delta: str, correct: str) -> DataFrame:
    """Accuracy in quartile bins of a delta, last bin closed."""
    return accuracy_by_percentile(deltas, delta, correct, QUARTILES, True)


def within_problem_median_split(
    df: DataFrame, value: str, correct: str, key: str = "problem_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per problem the accuracy at or above, and below, its median; then means over problems."""
    cells = cut_lineage(
        comparable(df, [value, correct], key).groupBy(key, value).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("bigint")).alias("right")
        ),
        "cells",
    )
    median = exact_percentiles(cells, value, [0.5], [key], "p", hot_rows, weight="n")
    high = F.col(value) >= F.col("p")[0]
    share = lambda cond: F.try_divide(F.sum(F.when(cond, F.col("right"))), F.sum(F.when(cond, F.col("n"))))
    per_problem = cells.join(median, key).groupBy(key).agg(
        share(high).alias("high"), share(~high).alias("low")
    )
    return per_problem.agg(
        F.avg("high").alias("high_accuracy"), F.count("high").alias("high_problems"),
        F.avg("low").alias("low_accuracy"), F.count("low").alias("low_problems"),
    )


def within_problem_deciles(
    df: DataFrame, value: str, correct: str, order: str = "response_idx", key: str = "problem_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per problem, responses sorted by ``value`` are cut into tenths; accuracy per slice, averaged
    over problems.

    Slice 0 takes at least one row, slices 10 to 90 span ``[int(n p), int(n (p + 10)))`` and are
    skipped if empty, slice 100 starts at ``int(0.9 n)``. Slices overlap only at 90 and 100.
    """
    rows = cut_lineage(
        comparable(df, [value, correct], key).select(key, order, value, correct), "rows"
    )
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    placed = ranked(rows, [key], value, order, "__pos", hot_rows).join(sizes, key)
    n, pos = F.col("__n"), F.col("__pos")
    bounds = []
    for p in SLICES:
        if p == 0:
            low, high = F.lit(0).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), F.floor(n * F.lit(0.1)))
        elif p == 100:
            low, high = F.floor(n * F.lit(0.9)), n
        else:
            low, high = F.floor(n * F.lit(p / 100)), F.floor(n * F.lit((p + 10) / 100))
        bounds.append(F.when((pos >= low) & (pos < high), F.lit(p)))
    sliced = placed.withColumn("slice", F.explode(F.array_compact(F.array(*bounds))))
    per_problem = sliced.groupBy(key, "slice").agg(
        F.avg(F.col(correct).cast("double")).alias("accuracy")
    )
    return per_problem.groupBy("slice").agg(
        F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("problems")
    )


def per_problem_bins(
    df: DataFrame, value: str, correct: str, scores: Sequence[str] = (), bins: int = 10,
    key: str = "problem_id",
) -> DataFrame:
    """Equal-width bins between a problem's minimum and maximum (last closed; one bin if constant):
    midpoint, count, accuracy and mean scores; empty bins are skipped."""
    rows = df.where(present(value) & F.col(correct).isNotNull())
    for s in scores:
        rows = rows.where(present(s))
    spans = rows.groupBy(key).agg(
        F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"),
        F.count(F.lit(1)).alias("__n"),
    ).where(F.col("__n") >= 2)
    width = (F.col("__hi") - F.col("__lo")) / F.lit(bins)
    place = F.floor(F.try_divide(F.col(value) - F.col("__lo"), width)).cast("int")
    index = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(
        F.least(place, F.lit(bins - 1))
    )
    middle = F.when(F.col("__hi") == F.col("__lo"), F.col("__lo")).otherwise(
        F.col("__lo") + width * (F.col("bin") + F.lit(0.5))
    )
    return (
        rows.join(spans, key).withColumn("bin", index).withColumn("midpoint", middle)
        .groupBy(key, "bin", "midpoint").agg(
            F.count(F.lit(1)).alias("count"),
            F.avg(F.col(correct).cast("double")).alias("accuracy"),
            *[F.avg(s).alias(s) for s in scores],
        )
    )
