"""pass@k, group rewards and accuracy summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voteframe.functions import grading as g
from voteframe.functions.grading import Grader
from voteframe.operators.ordering import row_numbers, with_positions

# The evaluated k and set sizes.
EVERY_UP_TO = 16
EXTRA_SIZE = 32


def adaptive_sizes(n: Column, smallest: int = 1) -> Column:
    """All sizes from ``smallest`` to min(16, n), and 32 if n reaches it."""
    candidates = [*range(smallest, EVERY_UP_TO + 1), EXTRA_SIZE]
    return F.filter(F.array(*[F.lit(k) for k in candidates]), lambda k: k <= n)


def candidate_sizes(smallest: int = 1) -> list[int]:
    """The same sizes as a list, for use where each set's fullness is checked later."""
    return [*range(smallest, EVERY_UP_TO + 1), EXTRA_SIZE]


def first_correct(
    df: DataFrame, keys: Sequence[str] = ("problem_id",), correct: str = "is_correct"
) -> DataFrame:
    """Per problem: responses and position of the first right one among those the problem has, in
    order of ``response_idx``; enough for every pass@k."""
    slim = with_positions(df.select(*keys, "response_idx", correct), keys, "response_idx", "__pos")
    return slim.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col(correct), F.col("__pos"))).alias("first_correct"),
    )


def pass_at_k(
    df: DataFrame, ks: Sequence[int] | None = None, keys: Sequence[str] = ("problem_id",),
    correct: str = "is_correct",
) -> DataFrame:
    """1.0 if any of the first k responses is right, else 0.0; k above the number of responses is
    skipped. ``ks=None`` uses the adaptive values."""
    firsts = first_correct(df, keys, correct)
    if ks is None:
        allowed = adaptive_sizes(F.col("n"))
    else:
        allowed = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k <= F.col("n"))
    spread = firsts.withColumn("k", F.explode(allowed))
    passed = F.coalesce(F.col("first_correct") < F.col("k"), F.lit(False))
    return spread.select(*keys, "k", passed.cast("double").alias("pass_at_k"))


def pass_at_k_fixed(
    df: DataFrame, keys: Sequence[str] = ("problem_id",), correct: str = "is_correct"
) -> DataFrame:
    """pass@1 (first response), pass@4 (any of the four sets of four, i.e. of the first 16) and
    pass@16, whatever the number of responses."""
    firsts = first_correct(df, keys, correct)
    among = lambda k: F.coalesce(F.col("first_correct") < k, F.lit(False)).cast("double")
    return firsts.select(
        *keys, among(1).alias("pass_at_1"), among(16).alias("pass_at_4"),
        among(16).alias("pass_at_16"),
    )


def pass_at_k_list(
    df: DataFrame, ks: Sequence[int] = (1, 5, 10), predictions: str = "predictions",
    truth: str = "ground_truth", grader: Grader = g.equivalent, start: str | None = None,
    keys: Sequence[str] = ("problem_id",),
) -> DataFrame:
    """Mean over problems of pass@k from a predictions array (or a single prediction, which counts
    for every k). With ``start``, the position of an array's first prediction, a problem may lie in
    several rows, which ``keys`` tell belong together."""
    preds = F.col(predictions)
    if dict(df.dtypes)[predictions] == "string":
        preds = F.array(preds)
    right = F.transform(preds, lambda p: F.coalesce(grader(p, F.col(truth)), F.lit(False)))
    hit = F.array_position(right, True)
    hits = df.withColumn("__hit", hit)
    if start is not None:
        least = F.min(F.when(hit > 0, hit + F.col(start)))
        hits = df.groupBy(*keys).agg(F.coalesce(least, F.lit(0)).alias("__hit"))
    means = hits.agg(
        *[F.avg(((F.col("__hit") > 0) & (F.col("__hit") <= k)).cast("double")).alias(str(k)) for k in ks]
    )
    long = means.unpivot([], [str(k) for k in ks], "k", "pass_at_k")
    return long.select(F.col("k").cast("int").alias("k"), F.coalesce("pass_at_k", F.lit(0.0)).alias("pass_at_k"))


def evaluate_metrics(
    df: DataFrame, scores: Sequence[str], keys: Sequence[str] = ("dataset", "model"),
    correct: str = "is_correct",
) -> DataFrame:
    """All pass@k, majority and weighted set votes for every k and set size, averaged over problems
    per ``keys``. A mean covers only the problems that have that k or size."""
    from voteframe.operators.voting import set_votes

    by = [*keys, "problem_id"]
    passes = pass_at_k(df, None, by, correct).select(
        *keys, F.lit("pass_at_k").alias("metric"), F.col("k").alias("size"),
        F.col("pass_at_k").alias("value"),
    )
    votes = set_votes(df, candidate_sizes(2), scores, by, correct).select(
        *keys, F.col("method").alias("metric"), F.col("set_size").alias("size"),
        F.col("accuracy").alias("value"),
    )
    return passes.unionByName(votes).groupBy(*keys, "metric", "size").agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("problems")
    )


def overall_summary(metrics: DataFrame, keys: Sequence[str] = ("model", "metric", "size")) -> DataFrame:
    """Unweighted mean of the per-dataset values."""
    return metrics.groupBy(*keys).agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("datasets")
    )


def group_advantages(
    df: DataFrame, size: int, reward: str = "reward", keys: Sequence[str] = ("problem_id",),
    order: str = "response_idx",
) -> DataFrame:
    """(reward - mean) / (population std + 1e-8) within consecutive groups of the responses a problem
    has, in order of ``order``; the last partial group is kept. Groups hold at most ``size`` rows, so
    the window is bounded."""
    numbered = row_numbers(df, keys, order, "__pos")
    grouped = numbered.withColumn("group_no", F.floor(F.col("__pos") / size)).drop("__pos")
    w = Window.partitionBy(*keys, "group_no")
    spread = F.stddev_pop(reward).over(w) + F.lit(1e-8)
    return grouped.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / spread)


def group_statistics(
    df: DataFrame, size: int, reward: str = "reward", keys: Sequence[str] = ("problem_id",),
    order: str = "response_idx",
) -> DataFrame:
    """Mean and population std of each full group of consecutive responses, in order of ``order``
    whatever its gaps, with the overall ones over all rows."""
    numbered = with_positions(df.select(*keys, order, reward), keys, order, "__pos")
    groups = numbered.withColumn("group_no", F.floor(F.col("__pos") / size)).groupBy(*keys, "group_no").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(reward).alias("group_mean"),
        F.stddev_pop(reward).alias("group_std"),
    ).where(F.col("rows") == size).drop("rows")
    return groups.withColumns(
        {
            "overall_mean": df.agg(F.avg(reward)).scalar(),
            "overall_std": df.agg(F.stddev_pop(reward)).scalar(),
        }
    )


def aggregation_summary(
    results: DataFrame, keys: Sequence[str] = ("aggregator", "variant_id")
) -> DataFrame:
    """Right answers, total and accuracy per aggregator and variant; ungraded counts as wrong."""
    return results.groupBy(*keys).agg(
        F.count_if(F.coalesce("is_correct", F.lit(False))).alias("correct"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)))


def regrade_pending(
    df: DataFrame, answer: str = "final_answer", truth: str = "ground_truth",
    grader: Grader = g.equivalent,
) -> DataFrame:
    """Grade only rows that have no grade yet and a non-empty answer."""
    filled = F.coalesce(F.col(answer), F.lit("")) != ""
    graded = F.when(filled, F.coalesce(grader(F.col(answer), F.col(truth)), F.lit(False)))
    return df.withColumn("is_correct", F.coalesce(F.col("is_correct"), graded))


def end_to_end_accuracy(
    results: DataFrame, keys: Sequence[str] = (), problem: str = "problem_id"
) -> DataFrame:
    """Right aggregated answers over the number of problems, not of attempts."""
    per_problem = results.groupBy(*keys, problem).agg(
        F.count_if(F.coalesce("is_correct", F.lit(False))).alias("correct")
    )
    return per_problem.groupBy(*keys).agg(
        F.sum("correct").alias("correct"), F.count(F.lit(1)).alias("total")
    ).withColumn("accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)))
