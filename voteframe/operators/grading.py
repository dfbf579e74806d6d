"""Grading of whole tables and reports about graders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from voteframe.functions import grading as g
from voteframe.functions import text as t
from voteframe.functions.grading import Grader


def parse_and_grade(
    df: DataFrame, mode: str = "reasoning", grader: Grader = g.equivalent
) -> DataFrame:
    """Add reasoning, content, final answer and both correctness flags to a response table."""
    raw = F.col("generated_text")
    parsed = df.withColumns(
        {
            "reasoning_content": F.coalesce(t.reasoning_content(raw), F.lit("")),
            "content": t.content_for_row(raw, mode),
        }
    ).withColumn("final_answer", t.final_answer(F.col("content")))
    answer, truth = F.col("final_answer"), F.col("ground_truth")
    return parsed.withColumns(
        {
            "is_correct_exact": g.is_correct_exact(answer, truth),
            "is_correct_equivalent": g.is_correct_equivalent(answer, truth, grader),
        }
    )


def grade_distinct(
    df: DataFrame, grader: Grader, answer: str = "final_answer", truth: str = "ground_truth",
    name: str = "is_correct",
) -> DataFrame:
    """Grade each distinct (answer, truth) pair once and join the flag back.

    Worth it for an expensive caller-supplied grader; the native one is cheaper applied row by row.
    Rows with an empty answer stay out of the join, so they cannot form one huge join key.
    """
    filled = df.where(F.coalesce(F.col(answer), F.lit("")) != "")
    blank = df.where(F.coalesce(F.col(answer), F.lit("")) == "").withColumn(name, F.lit(False))
    pairs = filled.select(answer, truth).distinct()
    graded = pairs.withColumn(name, F.coalesce(grader(F.col(answer), F.col(truth)), F.lit(False)))
    marks = graded.select(
        F.col(answer).alias("__a"), F.col(truth).alias("__t"), F.col(name)
    )
    on = (F.col(answer) == F.col("__a")) & F.col(truth).eqNullSafe(F.col("__t"))
    return filled.join(marks, on, "left").drop("__a", "__t").unionByName(blank)


def answer_classes(df: DataFrame, keys: list[str], answer: str = "final_answer") -> DataFrame:
    """Answers per group and class of equal ones (``answer_key``), with the smallest spelling.

    Classes are exact and transitive, so they are groups of one aggregation that combines on the map
    side: a hot class sends a row per task. Null answers are a class of their own.
    """
    keyed = df.withColumn("answer_key", g.answer_key(F.col(answer)))
    return keyed.groupBy(*keys, "answer_key").agg(F.count(F.lit(1)).alias("answers"), F.min(answer).alias("spelling"))


def grade_all(
    df: DataFrame, graders: dict[str, Grader], answer: str = "final_answer",
    truth: str = "ground_truth",
) -> DataFrame:
    """One boolean column per grader and ``any_correct``; empty answers are wrong everywhere."""
    flags: dict[str, Column] = {
        name: g.is_correct_equivalent(F.col(answer), F.col(truth), fn)
        for name, fn in graders.items()
    }
    graded = df.withColumns(flags)
    return graded.withColumn("any_correct", reduce(lambda a, b: a | b, [F.col(n) for n in flags]))


def grader_totals(graded: DataFrame, names: list[str]) -> DataFrame:
    """Right answers per grader, rows any grader accepts and rows all graders reject."""
    return graded.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(n)).alias(f"{n}_correct") for n in names],
        F.count_if(F.col("any_correct")).alias("any_correct"),
        F.count_if(~F.col("any_correct")).alias("all_failed"),
    )


def grader_agreement(
    df: DataFrame, first: str = "is_correct_exact", second: str = "is_correct_equivalent"
) -> DataFrame:
    """Both right, both wrong, only one right, with percentages."""
    a, b = F.col(first), F.col(second)
    cells = {
        "both_correct": a & b, "both_wrong": ~a & ~b, "only_exact": a & ~b, "only_equivalent": ~a & b,
    }
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"),
        *[F.count_if(c).alias(n) for n, c in cells.items()],
        *[(F.try_divide(F.count_if(c), total) * 100).alias(f"{n}_pct") for n, c in cells.items()],
    )


def count_correct(
    df: DataFrame, keys: list[str], answer: str = "final_answer", truth: str = "ground_truth",
    grader: Grader = g.equivalent,
) -> DataFrame:
    """Right answers per set; empty answers never count."""
    right = g.is_correct_equivalent(F.col(answer), F.col(truth), grader)
    return df.groupBy(*keys).agg(F.count_if(right).alias("correct_count"))


def empty_answer_overlap(df: DataFrame) -> DataFrame:
    """Rows with an empty final answer, an empty content, both, and the overlap each way."""
    no_answer = F.coalesce(F.col("final_answer"), F.lit("")) == ""
    no_content = F.coalesce(F.col("content"), F.lit("")) == ""
    answers, contents, both = (
        F.count_if(no_answer), F.count_if(no_content), F.count_if(no_answer & no_content),
    )
    return df.agg(
        answers.alias("empty_answers"),
        contents.alias("empty_contents"),
        both.alias("both_empty"),
        (F.try_divide(both, answers) * 100).alias("pct_of_empty_answers"),
        (F.try_divide(both, contents) * 100).alias("pct_of_empty_contents"),
    )
