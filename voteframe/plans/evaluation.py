"""From generated solutions to metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voteframe.functions import grading as g
from voteframe.functions.grading import Grader
from voteframe.operators.passk import evaluate_metrics, overall_summary
from voteframe.schemas import SET_VOTE_SCORES
from voteframe.session import cut_lineage
from voteframe.sources.readers import read_solution_results
from voteframe.sources.shards import union_all


def score_columns(scores: Sequence[str]) -> dict[str, Column]:
    """Named scores out of the ``confidence_scores`` map; a missing key is null."""
    return {s: F.try_element_at("confidence_scores", F.lit(s)) for s in scores}


def graded_solutions(
    spark: SparkSession, paths: dict[str, str], grader: Grader = g.equivalent,
    scores: Sequence[str] = SET_VOTE_SCORES, multi_line: bool = True,
) -> DataFrame:
    """Solutions of several models (name to path), flat and graded, without their texts."""
    parts = [
        read_solution_results(spark, path, multi_line).withColumn("model", F.lit(model))
        for model, path in paths.items()
    ]
    rows = union_all(parts).withColumns(score_columns(scores))
    right = g.is_correct_equivalent(F.col("final_answer"), F.col("ground_truth"), grader)
    return rows.select(
        F.col("dataset_name").alias("dataset"), "model", "problem_id", "response_idx",
        "final_answer", right.alias("is_correct"), *scores,
    )


def evaluate_files(
    spark: SparkSession, paths: dict[str, str], grader: Grader = g.equivalent,
    scores: Sequence[str] = SET_VOTE_SCORES, multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Metric table per dataset and model, and its mean over datasets. Answers are graded once and
    kept, whatever number of k and set sizes is evaluated."""
    graded = cut_lineage(graded_solutions(spark, paths, grader, scores, multi_line), "graded")
    metrics = cut_lineage(evaluate_metrics(graded, scores), "metrics")
    return metrics, overall_summary(metrics)
