"""Comparing two response tables by their problems."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def key_membership(a: DataFrame, b: DataFrame, key: str = "problem_id") -> DataFrame:
    """Every distinct key with flags in_a and in_b."""
    tagged = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return tagged.groupBy(key).agg(
        (F.max("a") == 1).alias("in_a"), (F.max("b") == 1).alias("in_b")
    )


def key_overlap(a: DataFrame, b: DataFrame, key: str = "problem_id") -> DataFrame:
    """One row: keys in a, in b, common, only in a, only in b."""
    in_a, in_b = F.col("in_a"), F.col("in_b")
    return key_membership(a, b, key).agg(
        F.count_if(in_a).alias("keys_a"), F.count_if(in_b).alias("keys_b"),
        F.count_if(in_a & in_b).alias("common"), F.count_if(in_a & ~in_b).alias("only_a"),
        F.count_if(~in_a & in_b).alias("only_b"),
    )


def restrict_to_common(df: DataFrame, other: DataFrame, key: str = "problem_id") -> DataFrame:
    """Rows of ``df`` whose key also occurs in ``other``."""
    return df.join(other.select(key).distinct(), key, "left_semi")


def compare_on_common(
    a: DataFrame, b: DataFrame,
    graders: Sequence[str] = ("is_correct_exact", "is_correct_equivalent"),
    key: str = "problem_id",
) -> DataFrame:
    """Accuracy per grader of both tables over their common problems, and b - a in percent points;
    null where a table lacks the grader's column."""

    def accuracy(df: DataFrame, other: DataFrame, side: str) -> DataFrame:
        rows = restrict_to_common(df, other, key)
        parts = {
            name: (F.avg(F.col(name).cast("double")) if name in df.columns else F.lit(None).cast("double"))
            for name in graders
        }
        one = rows.agg(F.count(F.lit(1)).alias(f"rows_{side}"), *[v.alias(n) for n, v in parts.items()])
        return one.unpivot([f"rows_{side}"], list(graders), "grader", f"accuracy_{side}")

    joined = accuracy(a, b, "a").join(accuracy(b, a, "b"), "grader")
    return joined.withColumn("difference_pp", (F.col("accuracy_b") - F.col("accuracy_a")) * 100)
