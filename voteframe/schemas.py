"""Explicit table schemas; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the confidence scores, in their canonical order.
SCORE_NAMES = (
    "mean_group_confidence",
    "bottom_10_percent_confidence",
    "tail_confidence",
    "head_confidence",
    "lowest_group_confidence",
    "top_10_percent_confidence",
    "highest_group_confidence",
)
# The six scores used by the correlation reports.
REPORT_SCORES = (
    "mean_group_confidence",
    "tail_confidence",
    "bottom_10_percent_confidence",
    "lowest_group_confidence",
    "top_10_percent_confidence",
    "highest_group_confidence",
)
# The scores usable as vote weights when evaluating sets.
SET_VOTE_SCORES = (
    "mean_group_confidence",
    "bottom_10_percent_confidence",
    "tail_confidence",
    "lowest_group_confidence",
)
# Short names of the per-problem weighted votes and the score behind each.
PROBLEM_VOTE_SCORES = {
    "bottom10": "bottom_10_percent_confidence",
    "lowest": "lowest_group_confidence",
    "tail": "tail_confidence",
}

LOGPROBS = T.ArrayType(T.ArrayType(T.FloatType()))

PROBLEMS = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("id", "problem", "answer")]
)

BENCHMARK = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("problem", "question", "answer", "solution")]
)

RESPONSES = T.StructType(
    [
        T.StructField("problem_id", T.StringType()),
        T.StructField("problem_text", T.StringType()),
        T.StructField("ground_truth", T.StringType()),
        T.StructField("response_id", T.StringType()),
        T.StructField("generated_text", T.StringType()),
        T.StructField("output_token_count", T.IntegerType()),
        T.StructField("logprobs", LOGPROBS),
        T.StructField("worker_gpu", T.StringType()),
        T.StructField("worker_replica", T.StringType()),
        *[T.StructField(name, T.DoubleType()) for name in SCORE_NAMES],
    ]
)

SCORES = T.StructType([T.StructField(name, T.DoubleType()) for name in SCORE_NAMES])

SOLUTION_RESULTS = T.StructType(
    [
        T.StructField("dataset_name", T.StringType()),
        T.StructField("total_problems", T.LongType()),
        T.StructField(
            "generated_solutions",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("problem_id", T.StringType()),
                        T.StructField("problem_text", T.StringType()),
                        T.StructField("ground_truth", T.StringType()),
                        T.StructField("start", T.LongType()),
                        T.StructField(
                            "solutions",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("generated_text", T.StringType()),
                                        T.StructField("reasoning_content", T.StringType()),
                                        T.StructField("content", T.StringType()),
                                        T.StructField("final_answer", T.StringType()),
                                        T.StructField(
                                            "confidence_scores",
                                            T.MapType(T.StringType(), T.DoubleType()),
                                        ),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)
