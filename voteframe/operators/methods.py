"""Comparison of grading and voting methods over graded, vote-flagged responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Flag columns, in the order of the reports.
EXACT = "is_correct_exact"
EQUIVALENT = "is_correct_equivalent"
MAJORITY = "is_correct_majority"
WEIGHTED = ("is_correct_weighted_bottom10", "is_correct_weighted_lowest", "is_correct_weighted_tail")
ALL_METHODS = (EXACT, EQUIVALENT, MAJORITY, *WEIGHTED)


def _all(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags)


def _short(name: str) -> str:
    return name.removeprefix("is_correct_")


def method_comparison(voted: DataFrame, key: str = "problem_id") -> DataFrame:
    """Accuracy of both graders per response and of every vote per problem, in long form."""
    per_problem = voted.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(c).alias(c) for c in (EXACT, EQUIVALENT)],
        *[F.max(c).cast("int").alias(c) for c in (MAJORITY, *WEIGHTED)],
    )
    totals = per_problem.agg(
        F.sum("rows").alias("responses"), F.count(F.lit(1)).alias("problems"),
        *[F.sum(c).cast("bigint").alias(c) for c in ALL_METHODS],
    )
    long = totals.unpivot(["responses", "problems"], list(ALL_METHODS), "method", "correct")
    per_response = F.col("method").isin(EXACT, EQUIVALENT)
    total = F.when(per_response, F.col("responses")).otherwise(F.col("problems"))
    return long.select(
        F.regexp_replace("method", "^is_correct_", "").alias("method"),
        F.when(per_response, "response").otherwise("problem").alias("unit"),
        "correct", total.alias("total"), F.try_divide("correct", total).alias("accuracy"),
    )


def pair_cells(a: Column, b: Column, first: str, second: str) -> dict[str, Column]:
    """The four outcomes of two methods."""
    return {
        f"{first}_{second}_both": a & b,
        f"{first}_{second}_neither": ~a & ~b,
        f"{first}_{second}_only_{first}": a & ~b,
        f"{first}_{second}_only_{second}": ~a & b,
    }


def method_agreement(voted: DataFrame) -> DataFrame:
    """Counts of agreement between the six methods, in one pass and one row."""
    flags = [F.col(c) for c in ALL_METHODS]
    b10, low, tail = (F.col(c) for c in WEIGHTED)
    cells = {
        "total": F.lit(True),
        "all_correct": _all(flags),
        "all_wrong": _all([~f for f in flags]),
        **pair_cells(F.col(EXACT), F.col(EQUIVALENT), "exact", "equivalent"),
        **{
            name: cond
            for w in WEIGHTED
            for name, cond in pair_cells(
                F.col(MAJORITY), F.col(w), "majority", _short(w)
            ).items()
        },
        **pair_cells(b10, low, "bottom10", "lowest"),
        "weighted_all": b10 & low & tail,
        "weighted_none": ~b10 & ~low & ~tail,
        "weighted_only_bottom10": b10 & ~low & ~tail,
        "weighted_only_lowest": ~b10 & low & ~tail,
        "weighted_only_tail": ~b10 & ~low & tail,
        "weighted_bottom10_lowest": b10 & low & ~tail,
        "weighted_bottom10_tail": b10 & ~low & tail,
        "weighted_lowest_tail": ~b10 & low & tail,
    }
    return voted.agg(*[F.count_if(c).alias(n) for n, c in cells.items()])


def problem_level_comparison(voted: DataFrame, key: str = "problem_id") -> DataFrame:
    """Per problem any right response per grader and the vote flags; then counts over problems."""
    per_problem = voted.groupBy(key).agg(*[F.bool_or(c).alias(c) for c in ALL_METHODS])
    flags = [F.col(c) for c in ALL_METHODS]
    return per_problem.agg(
        F.count(F.lit(1)).alias("problems"),
        *[F.count_if(c).alias(f"{_short(c)}_correct") for c in ALL_METHODS],
        F.count_if(_all(flags)).alias("all_correct"),
        F.count_if(_all([~f for f in flags])).alias("all_wrong"),
    )
