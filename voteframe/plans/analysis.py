"""From raw responses to all reports about a response table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from voteframe.functions import grading as g
from voteframe.functions.grading import Grader
from voteframe.operators import correlation as co, distributions as di, methods as om, voting as v
from voteframe.operators.grading import grader_agreement, parse_and_grade
from voteframe.operators.scoring import recalculate_confidence
from voteframe.operators.selection import total_tokens
from voteframe.schemas import REPORT_SCORES
from voteframe.session import cut_lineage
from voteframe.sources.shards import drop_logprobs, merge_shards
from voteframe.sources.writers import write_table


def voted_responses(df: DataFrame, grader: Grader = g.equivalent) -> DataFrame:
    """Parse and grade a response table (unless it already is), vote per problem, and put the vote
    flags on every response. Log-probabilities are dropped before anything is shuffled."""
    rows = drop_logprobs(df)
    if "final_answer" not in rows.columns or "is_correct_equivalent" not in rows.columns:
        rows = parse_and_grade(rows, grader=grader)
    return v.attach_votes(rows, v.problem_votes(rows, grader=grader))


def response_reports(
    df: DataFrame, scores: Sequence[str] = REPORT_SCORES, grader: Grader = g.equivalent
) -> dict[str, DataFrame]:
    """All reports about a response table, by name.

    The parsed, graded and voted rows are written once to the shared folder without their long
    texts; every report then scans only the columns it needs.
    """
    voted = voted_responses(df, grader)
    voted = voted.withColumn("total_tokens", total_tokens(voted))
    slim = cut_lineage(voted.drop("generated_text", "reasoning_content", "content", "problem_text"), "voted")
    have = [s for s in scores if s in slim.columns]
    right = "is_correct_equivalent"
    reports = {
        "grader_agreement": grader_agreement(slim),
        "method_comparison": om.method_comparison(slim),
        "method_agreement": om.method_agreement(slim),
        "problem_level_comparison": om.problem_level_comparison(slim),
        "token_distribution": di.token_distribution(slim),
        "token_bins": di.token_bins(slim),
        "accuracy_by_total_tokens": di.accuracy_by_quantile_bins(slim, "total_tokens", right, have),
    }
    for score in have:
        reports[f"{score}/pearson"] = co.pearson(slim, score, right, with_p=True)
        reports[f"{score}/spearman"] = co.spearman(slim, score, right, with_p=True)
        reports[f"{score}/by_correctness"] = di.confidence_by_correctness(slim, score, right)
        reports[f"{score}/accuracy_by_percentile"] = di.accuracy_by_percentile(
            slim, score, right, di.ACCURACY_PERCENTILES, closed_last=False
        )
        reports[f"{score}/histogram"] = di.confidence_histogram(slim, score, right)
    return reports


def merge_and_report(
    spark: SparkSession, folder: str, out: str, grader: Grader = g.equivalent
) -> dict[str, DataFrame]:
    """Merge shard files, write the parsed table without log-probabilities, and report on it."""
    parsed = parse_and_grade(drop_logprobs(merge_shards(spark, folder)), grader=grader)
    write_table(parsed, out)
    return response_reports(spark.read.schema(parsed.schema).parquet(out), grader=grader)


def recalculate_file(
    spark: SparkSession, source: str, out: str, group: int, json_text: bool = False
) -> dict[str, int]:
    """Rewrite a response file with fresh scores; valid and invalid rows are counted while writing,
    without a second pass."""
    df = recalculate_confidence(spark.read.parquet(source), group, json_text)
    seen = Observation("recalculation")
    counted = df.observe(
        seen, F.count(F.lit(1)).alias("total"),
        F.sum(F.col("has_scores").cast("bigint")).alias("valid"),
    )
    write_table(counted.drop("has_scores"), out)
    total, valid = seen.get["total"], seen.get["valid"] or 0
    return {"total": total, "valid": valid, "invalid": total - valid}
