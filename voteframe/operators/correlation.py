"""Correlations of scores, token counts and correctness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from voteframe.functions.probability import p_value
from voteframe.operators.distributions import present
from voteframe.operators.ordering import average_ranks, sample_key
from voteframe.operators.pair_correlations import centred_ranks, pair_correlations, rho, safe_corr, two_valued_rho
from voteframe.session import cut_lineage

# Thresholds of the per-problem correlation overview.
STRONG = 0.3
WEAK = 0.1
SIGNIFICANT = 0.05


def _pair(df: DataFrame, x: str, y: str) -> DataFrame:
    ready = present(x) & present(y)
    return df.withColumns(
        {
            "__x": F.when(ready, F.col(x).cast("double")),
            "__y": F.when(ready, F.col(y).cast("double")),
        }
    )


def pearson(
    df: DataFrame, x: str, y: str, keys: Sequence[str] = (), with_p: bool = False
) -> DataFrame:
    """n and r over the rows where both columns are present; optionally the two-sided p-value."""
    if dict(df.dtypes)[y] == "boolean":
        df = df.withColumn(y, F.col(y).cast("int"))
    out = _pair(df, x, y).groupBy(*keys).agg(
        F.count("__x").alias("n"), safe_corr(F.col("__x"), F.col("__y")).alias("r")
    )
    return out.withColumn("p_value", p_value(F.col("r"), F.col("n"))) if with_p else out


def spearman(
    df: DataFrame, x: str, y: str, keys: Sequence[str] = (), with_p: bool = False
) -> DataFrame:
    """Pearson correlation of average ranks.

    Rows are first counted per distinct value; ranks come from those counts and are centred, so the
    coefficient needs only three sums. A boolean ``y`` isn't ranked: the counts of x say how many of the rows
    are true. ``keys`` name few, large groups (a metric, a dataset).
    """
    keys = list(keys)
    two_valued = dict(df.dtypes)[y] == "boolean"
    rows = _pair(df, x, y).where(F.col("__x").isNotNull()).select(*keys, "__x", "__y")
    n = F.col("__n")
    if two_valued:
        cells = rows.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__n"), F.sum("__y").alias("__ones"))
        placed = centred_ranks(cut_lineage(cells, "cells"), keys, "__x", "__n")
        rank = F.col("__rank")
        coefficient = two_valued_rho(F.sum(n), F.sum("__ones"), F.sum(F.col("__ones") * rank), F.sum(n * rank * rank))
    else:
        cells = rows.groupBy(*keys, "__x", "__y").agg(F.count(F.lit(1)).alias("__n"))
        rx = average_ranks(cells, "__x", keys, "__rx", chunk="always", weight="__n")
        ry = average_ranks(cells, "__y", keys, "__ry", chunk="always", weight="__n")
        placed = cells.join(rx, [*keys, "__x"]).join(ry, [*keys, "__y"])
        a, b = F.col("__rx"), F.col("__ry")
        coefficient = rho(F.sum(n * a * b), F.sum(n * a * a), F.sum(n * b * b))
    out = placed.groupBy(*keys).agg(F.sum(n).alias("n"), coefficient.alias("rho"))
    return out.withColumn("p_value", p_value(F.col("rho"), F.col("n"))) if with_p else out


def correlation_matrix(
    df: DataFrame, scores: Sequence[str], tokens: str, correct: str, with_p: bool = False
) -> DataFrame:
    """Pearson and Spearman of tokens and every score with correctness, and of every score with
    tokens, in long form. A pair with at most one row or a constant first column is left out. All
    pairs share one ranking of the columns."""
    grade = "__accuracy"
    columns = {s: F.col(s) for s in scores} | {tokens: F.col(tokens), grade: F.col(correct)}
    pairs = [(c, grade) for c in (tokens, *scores)] + [(s, tokens) for s in scores]
    two = [grade] if dict(df.dtypes)[correct] == "boolean" else []
    found = pair_correlations(df, columns, pairs, two).where("n > 1 and varied").drop("varied")
    out = found.withColumn("y", F.when(F.col("y") == grade, "accuracy").otherwise("tokens"))
    if with_p:
        out = out.withColumns(
            {
                "pearson_p": p_value(F.col("pearson"), F.col("n")),
                "spearman_p": p_value(F.col("spearman"), F.col("n")),
            }
        )
    return out


def confidence_correlation(df: DataFrame, score: str, correct: str) -> DataFrame:
    """Pearson coefficient plus accuracy in half-open quartile bins, empty bins as 0.0."""
    from voteframe.operators.distributions import QUARTILES, accuracy_by_percentile

    bins = accuracy_by_percentile(df, score, correct, QUARTILES, False, keep_empty=True)
    return bins.withColumn("pearson", pearson(df, score, correct).select("r").scalar())


def per_problem_correlation(
    df: DataFrame, value: str, correct: str, key: str = "problem_id", with_p: bool = False
) -> DataFrame:
    """Problems with at least two rows: r of value and correctness (0 for constant values, null for
    constant grades), accuracy, mean and population std of the value."""
    x, c = F.col(value).cast("double"), F.col(correct).cast("double")
    out = df.where(F.col(value).isNotNull() & F.col(correct).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(c).alias("accuracy"), F.avg(x).alias("value_mean"),
        F.stddev_pop(x).alias("value_std"), safe_corr(x, c).alias("__r"),
        (F.min(x) == F.max(x)).alias("__constant"),
    ).where(F.col("n") >= 2)
    out = out.withColumn("r", F.when(F.col("__constant"), F.lit(0.0)).otherwise(F.col("__r")))
    if with_p:
        p = p_value(F.col("r"), F.col("n"))
        out = out.withColumn("p_value", F.when(F.col("__constant"), F.lit(1.0)).otherwise(p))
    return out.drop("__r", "__constant")


def correlation_overview(by_problem: DataFrame) -> DataFrame:
    """Statistics of r over problems and counts by sign, strength and significance."""
    from voteframe.operators.ordering import exact_percentiles

    r = F.col("r")
    significant = F.col("p_value") < SIGNIFICANT
    return by_problem.agg(
        F.count(F.lit(1)).alias("problems"), F.avg(r).alias("mean"),
        F.stddev_pop(r).alias("std"), F.min(r).alias("min"), F.max(r).alias("max"),
        F.count_if(significant).alias("significant"),
        F.count_if(significant & (r > 0)).alias("significant_positive"),
        F.count_if(significant & (r < 0)).alias("significant_negative"),
        F.count_if(r > 0).alias("positive"), F.count_if(r < 0).alias("negative"),
        F.count_if(F.abs(r) < WEAK).alias("weak"),
    ).withColumn(
        "median",
        exact_percentiles(by_problem, "r", [0.5]).select(F.col("percentiles")[0]).scalar(),
    )


def representative_problems(
    by_problem: DataFrame, strongest: int = 5, weak: int = 3, key: str = "problem_id"
) -> DataFrame:
    """Up to five strongest positive and negative problems and three weak ones in hash order."""
    r = F.col("r")
    positive = by_problem.where(r > STRONG).orderBy(F.desc("r"), key).limit(strongest)
    negative = by_problem.where(r < -STRONG).orderBy("r", key).limit(strongest)
    none = by_problem.where(F.abs(r) < WEAK).orderBy(sample_key(key), key).limit(weak)
    return (
        positive.withColumn("kind", F.lit("positive"))
        .unionByName(negative.withColumn("kind", F.lit("negative")))
        .unionByName(none.withColumn("kind", F.lit("weak")))
    )
