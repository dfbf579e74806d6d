"""Merging shard files and tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from voteframe.operators.overlap import key_overlap

BULKY = ("logprobs", "generated_text")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing from a part are null there."""
    if not frames:
        raise ValueError("nothing to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_shards(spark: SparkSession, folder: str, exclude: str | None = None) -> DataFrame:
    """All Parquet files of a folder as one table, tolerant of missing columns; the file named
    ``exclude`` (an earlier output) is left out."""
    reader = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet"
    )
    df = reader.parquet(folder)
    if exclude is None:
        return df
    base = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    parent = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.where((base != exclude) & (parent != exclude))


def merge_report(df: DataFrame) -> DataFrame:
    """Per worker_replica and in total (replica null): responses, problems, mean per problem."""
    per_problem = df.groupBy("worker_replica", "problem_id").agg(F.count(F.lit(1)).alias("n"))
    by_replica = per_problem.groupBy("worker_replica").agg(
        F.sum("n").alias("responses"), F.count(F.lit(1)).alias("problems")
    )
    total = per_problem.groupBy("problem_id").agg(F.sum("n").alias("n")).agg(
        F.lit(None).cast("string").alias("worker_replica"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("responses"), F.count(F.lit(1)).alias("problems"),
    )
    return by_replica.unionByName(total).withColumn(
        "mean_responses", F.try_divide("responses", "problems")
    )


def slim(df: DataFrame) -> DataFrame:
    """Without the bulky columns; with Parquet they are never read."""
    return df.drop(*BULKY)


def merge_shards_slim(
    spark: SparkSession, folder: str, out: str, exclude: str | None = None
) -> DataFrame:
    """Write the merged table without the bulky columns; the returned frame keeps them."""
    df = merge_shards(spark, folder, exclude)
    slim(df).write.option("compression", "zstd").mode("errorifexists").parquet(out)
    return df


def merge_if_same_keys(a: DataFrame, b: DataFrame, key: str = "problem_id") -> DataFrame:
    """Union of both tables if they have exactly the same keys, otherwise no rows.

    The gate is a one-row subquery, so the decision is part of the plan; use
    :func:`key_overlap` to report what differs.
    """
    differing = key_overlap(a, b, key).select(F.col("only_a") + F.col("only_b")).scalar()
    return union_all([a, b]).where(differing == 0)


def drop_logprobs(df: DataFrame, cleaning: bool = False) -> DataFrame:
    """Drop ``logprobs``; for cleaning every column whose name mentions log-probabilities."""
    if not cleaning:
        return df.drop("logprobs")
    named = [c for c in df.columns if "logprobs" in c.lower() or "log_prob" in c.lower()]
    return df.drop(*named)
