"""Confidence scoring of response tables and checks of their log-probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voteframe.functions import confidence, logprobs as lp
from voteframe.schemas import SCORE_NAMES


def token_rows(df: DataFrame, key: str, tokens: str = "token_confidence") -> DataFrame:
    """Long form: one row per token position (for inspection; scoring does not need it)."""
    return df.select(key, F.posexplode(tokens).alias("pos", "confidence"))


def score_responses(
    df: DataFrame, group: int = confidence.DEFAULT_GROUP, empty: str = "zero"
) -> DataFrame:
    """Add the seven scores computed from ``logprobs``. A map-only job: no shuffle."""
    scores = confidence.all_confidence(F.col("logprobs"), group, empty)
    scored = df.withColumn("__scores", scores)
    return scored.select("*", *[F.col("__scores")[n].alias(n) for n in SCORE_NAMES]).drop("__scores")


def recalculate_confidence(
    df: DataFrame, group: int = confidence.DEFAULT_GROUP, json_text: bool = False
) -> DataFrame:
    """Replace the scores by freshly computed ones and drop the log-probabilities. Rows without
    log-probabilities get NaN scores and ``has_scores = false``."""
    if json_text:
        df = df.withColumn("logprobs", lp.normalize_json(F.col("logprobs")))
    kept = df.drop(*SCORE_NAMES)
    scored = score_responses(kept, group, "nan")
    return scored.withColumn(
        "has_scores", F.coalesce(F.size("logprobs"), F.lit(0)) > 0
    ).drop("logprobs")


def recalculation_report(scored: DataFrame) -> DataFrame:
    """Valid and invalid rows of a recalculation."""
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("has_scores").alias("valid"),
        F.count_if(~F.col("has_scores")).alias("invalid"),
    )


def logprob_quality(df: DataFrame, k: int = 5) -> DataFrame:
    """Per response: tokens, tokens with exactly ``k`` values, whether all of them have.

    ``no_bad_token`` is true for a null or empty response (nothing contradicts it); ``is_valid``
    is false for one.
    """
    lp_col = F.col("logprobs")
    exact = F.size(F.filter(lp_col, lambda t: F.size(t) == k))
    tokens = F.greatest(F.coalesce(F.size(lp_col), F.lit(0)), F.lit(0))
    return (
        df.withColumn("num_tokens", tokens)
        .withColumn("num_tokens_ok", F.greatest(F.coalesce(exact, F.lit(0)), F.lit(0)))
        .withColumn("no_bad_token", F.col("num_tokens") == F.col("num_tokens_ok"))
        .withColumn("is_valid", F.col("no_bad_token") & (F.col("num_tokens") > 0))
    )


def logprob_quality_totals(quality: DataFrame) -> DataFrame:
    """Valid, invalid and wrongly sized responses over the whole table."""
    return quality.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.count_if(~F.col("no_bad_token") & (F.col("num_tokens") > 0)).alias("wrong_size"),
    )


def logprob_quality_by_problem(quality: DataFrame, key: str = "problem_id") -> DataFrame:
    """Per problem: responses, valid ones (null counts as valid here), ratio and status."""
    counted = quality.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("no_bad_token").alias("valid")
    )
    status = (
        F.when(F.col("valid") == F.col("total"), "all")
        .when(F.col("valid") == 0, "none")
        .otherwise("partial")
    )
    return counted.withColumns(
        {"valid_ratio": F.col("valid") / F.col("total"), "status": status}
    )


def worst_problems(by_problem: DataFrame, n: int = 10, key: str = "problem_id") -> DataFrame:
    """The ``n`` problems with the lowest valid ratio; ties by key."""
    return by_problem.orderBy("valid_ratio", key).limit(n)
