"""Majority and confidence-weighted voting.

Answers are counted per (problem, answer) first, which combines on the map side, so a problem or an
answer holding a large share of all rows shuffles only as many rows as it has distinct answers per
task. Ties go to the answer seen first, by ``response_idx``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voteframe.functions import grading as g
from voteframe.functions.grading import Grader
from voteframe.functions.text import strip
from voteframe.operators.ordering import HOT_ROWS, row_numbers
from voteframe.schemas import PROBLEM_VOTE_SCORES

#: Rows that one task of the set votes gets, on average: behind the shuffle each is copied for every set size.
TASK_ROWS = 25_000


def clean_score(name: str) -> Column:
    """A score as vote weight: null and NaN count as 0."""
    return F.coalesce(F.nanvl(F.col(name), F.lit(None).cast("double")), F.lit(0.0))


def tally(
    df: DataFrame, keys: Sequence[str], answer: Column, weights: dict[str, Column] | None = None,
    extra: Sequence[Column] = (), order: str = "response_idx",
) -> DataFrame:
    """Votes, first position and weight sums per key and answer (null answer = no vote)."""
    return df.withColumn("answer", answer).groupBy(*keys, "answer").agg(
        F.count(F.lit(1)).alias("votes"),
        F.min(order).alias("first_idx"),
        *[F.sum(w).alias(f"weight_{n}") for n, w in (weights or {}).items()],
        *extra,
    )


def winner(value: Column, strength: Column, voted: Column) -> Column:
    """Aggregate: ``value`` of the strongest entry, first seen on ties, null if nobody voted."""
    rank = F.when(voted, F.struct(strength.alias("s"), (-F.col("first_idx")).alias("i")))
    return F.max_by(value, rank)


def problem_votes(
    df: DataFrame, scores: dict[str, str] | None = None, keys: Sequence[str] = ("problem_id",),
    grader: Grader = g.equivalent,
) -> DataFrame:
    """Per problem: majority answer and one weighted answer per score, each graded.

    Blank answers do not vote; a problem with blanks only gets '' and is wrong. The truth belongs to
    the problem, so it is part of the grouping.
    """
    scores = PROBLEM_VOTE_SCORES if scores is None else scores
    keys = [*keys, "ground_truth"]
    text = strip(F.col("final_answer"))
    counted = tally(
        df, keys, F.when(text != "", text), {n: clean_score(c) for n, c in scores.items()}
    )
    voted = F.col("answer").isNotNull()
    strengths = {"majority_answer": F.col("votes")}
    strengths |= {f"weighted_answer_{n}": F.col(f"weight_{n}") for n in scores}
    votes = counted.groupBy(*keys).agg(
        *[
            F.coalesce(winner(F.col("answer"), s, voted), F.lit("")).alias(n)
            for n, s in strengths.items()
        ]
    )
    truth = F.col("ground_truth")
    flags = {
        "is_correct_majority": g.is_correct_equivalent(F.col("majority_answer"), truth, grader)
    }
    for n in scores:
        answer = F.col(f"weighted_answer_{n}")
        flags[f"is_correct_weighted_{n}"] = g.is_correct_equivalent(answer, truth, grader)
    return votes.withColumns(flags)


def majority_vote(df: DataFrame, keys: Sequence[str] = ("problem_id",)) -> DataFrame:
    """Per problem: the most frequent non-blank answer and whether it is right."""
    return problem_votes(df, {}, keys)


def weighted_vote(
    df: DataFrame, score: str, keys: Sequence[str] = ("problem_id",)
) -> DataFrame:
    """Per problem: the answer with the largest sum of ``score`` and whether it is right."""
    votes = problem_votes(df, {"score": score}, keys)
    return votes.select(
        *keys, "ground_truth",
        F.col("weighted_answer_score").alias("weighted_answer"),
        F.col("is_correct_weighted_score").alias("is_correct_weighted"),
    )


def attach_votes(
    df: DataFrame, votes: DataFrame, keys: Sequence[str] = ("problem_id",)
) -> DataFrame:
    """Put the per-problem vote flags on every response; unknown problems are wrong."""
    flags = [c for c in votes.columns if c.startswith("is_correct_")]
    match = {k: f"__{k}" for k in (*keys, "ground_truth")}
    marks = votes.select(*[F.col(k).alias(m) for k, m in match.items()], *flags)
    on = [F.col(k).eqNullSafe(F.col(m)) for k, m in match.items()]
    joined = df.join(marks, on, "left").drop(*match.values())
    return joined.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})


def numbered_in_tasks(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """``row_numbers`` for rows that multiply behind the shuffle: the number of tasks grows with the
    rows, so that what a task holds does not. One job counts the rows per key. With an oversized key
    the rows are numbered in chunks instead."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.sum("n").alias("rows"), F.max("n").alias("largest")).first()
    if (found.largest or 0) > HOT_ROWS:
        return row_numbers(df, keys, order, name)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-(found.rows or 0) // TASK_ROWS))
    return row_numbers(df.repartition(tasks, *keys), keys, order, name, chunk="never")


def set_votes(
    df: DataFrame, sizes: Sequence[int], scores: Sequence[str] = (),
    keys: Sequence[str] = ("problem_id",), correct: str = "is_correct",
) -> DataFrame:
    """Voting over consecutive sets of each size, in long form.

    Sets are cut from the responses a problem has, in order of ``response_idx``; gaps in it do not
    matter. A problem of n responses has floor(n / size) sets; a set in which nobody answered is wrong but
    counted. Empty answers do not vote and answers are compared as they are. ``correct`` grades the
    row's own answer. Output: keys, method, set_size, correct_count, total_sets, accuracy.
    """
    keys = list(keys)
    # Numbering shuffles each response once, by problem; the copies for the sizes are made behind
    # that shuffle and counted where they are.
    slim = df.select(*keys, "response_idx", "final_answer", correct, *scores)
    spread = numbered_in_tasks(slim, keys, "response_idx", "__pos").withColumn(
        "set_size", F.explode(F.array(*[F.lit(s) for s in sizes]))
    ).withColumn("set_no", F.floor(F.col("__pos") / F.col("set_size")))
    answer = F.when(F.col("final_answer") != "", F.col("final_answer"))
    cells = tally(
        spread, [*keys, "set_size", "set_no"], answer,
        {s: clean_score(s) for s in scores}, [F.max(correct).alias("right")],
    )
    voted = F.col("answer").isNotNull()
    methods = {"majority_voting": F.col("votes"), **{s: F.col(f"weight_{s}") for s in scores}}
    sets = (
        cells.groupBy(*keys, "set_size", "set_no")
        .agg(
            F.sum("votes").alias("rows"),
            *[
                F.coalesce(winner(F.col("right"), w, voted), F.lit(False)).alias(m)
                for m, w in methods.items()
            ],
        )
        .where(F.col("rows") == F.col("set_size"))
    )
    per_problem = sets.groupBy(*keys, "set_size").agg(
        F.count(F.lit(1)).alias("total_sets"), *[F.count_if(m).alias(m) for m in methods]
    )
    long = per_problem.unpivot(
        [*keys, "set_size", "total_sets"], list(methods), "method", "correct_count"
    )
    return long.withColumn("accuracy", F.col("correct_count") / F.col("total_sets"))


def set_votes_fixed16(
    df: DataFrame, scores: Sequence[str] = (), keys: Sequence[str] = ("problem_id",),
    grader: Grader = g.equivalent,
) -> DataFrame:
    """Voting over exactly 16/size sets of the first 16 responses for sizes 2, 4, 8, 16.

    The first 16 are those a problem has, in order of ``response_idx``, whatever gaps there are.
    Empty answers vote too, a set without rows yields '', and the denominators never change.
    """
    keys = list(keys)
    slim = df.select(*keys, "response_idx", "final_answer", "ground_truth", *scores)
    # Spark applies this limit before the shuffle as well.
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("response_idx"))
    spread = slim.withColumn("__number", number).where(F.col("__number") <= 16).withColumn(
        "set_size", F.explode(F.array(*[F.lit(s) for s in (2, 4, 8, 16)]))
    ).withColumn("set_no", F.floor((F.col("__number") - 1) / F.col("set_size")))
    keys = [*keys, "ground_truth"]
    answer = F.coalesce(F.col("final_answer"), F.lit(""))
    truth = F.col("ground_truth")
    cells = tally(
        spread, [*keys, "set_size", "set_no"], answer, {s: clean_score(s) for s in scores}
    ).withColumn("right", F.coalesce(grader(F.col("answer"), truth), F.lit(False)))
    methods = {"majority_voting": F.col("votes"), **{s: F.col(f"weight_{s}") for s in scores}}
    sets = cells.groupBy(*keys, "set_size", "set_no").agg(
        *[winner(F.col("right"), w, F.lit(True)).alias(m) for m, w in methods.items()],
    )
    # A set without rows answers ''; that is only right where the truth is blank.
    missing = F.lit(16) / F.col("set_size") - F.col("seen")
    blank_truth = F.coalesce(grader(F.lit(""), truth), F.lit(False))
    filled = F.when(blank_truth, missing.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    per_problem = sets.groupBy(*keys, "set_size").agg(
        F.count(F.lit(1)).alias("seen"), *[F.count_if(m).alias(m) for m in methods],
    ).withColumns({m: F.col(m) + filled for m in methods})
    long = per_problem.withColumn(
        "total_sets", (F.lit(16) / F.col("set_size")).cast("bigint")
    ).unpivot([*keys, "set_size", "total_sets"], list(methods), "method", "correct_count")
    return long.withColumn("accuracy", F.col("correct_count") / F.col("total_sets"))


def best_by_confidence(
    df: DataFrame, scores: Sequence[str], text: str = "generated_text",
    keys: Sequence[str] = ("problem_id",), order: str = "response_idx",
) -> DataFrame:
    """Per problem: the response with the highest mean of its scores, first on ties, '' if none."""
    present = F.filter(F.array(*scores), lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    score = F.when(F.size(present) > 0, total / F.size(present))
    rank = F.when(score.isNotNull(), F.struct(score.alias("s"), (-F.col(order)).alias("i")))
    return df.groupBy(*keys).agg(
        F.coalesce(F.max_by(text, rank), F.lit("")).alias("best_text"),
        F.max(score).alias("best_score"),
    )


def softmax_sample(
    df: DataFrame, score: str, temperature: float, seed: int = 42, text: str = "generated_text",
    key: str = "problem_id", order: str = "response_idx",
) -> DataFrame:
    """Per problem: one response drawn with probability softmax(score / temperature); at
    temperature 0 or below the highest score.

    The draw is the largest ``score / temperature + g`` with g a Gumbel variable for each response, made from
    the hash of problem, position and seed. That has the softmax's probabilities without the sum of the weights,
    so one aggregation with map-side combine draws for all problems. Responses without a score are not drawn.
    """
    from voteframe.operators.ordering import sample_key

    scored = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    value = F.col(score)
    if temperature > 0:
        number = F.conv(F.substring(sample_key(key, order, seed=seed), 1, 13), 16, 10).cast("double")
        uniform = (number + 0.5) / F.lit(float(16**13))
        value = F.col(score) / F.lit(float(temperature)) - F.ln(-F.ln(uniform))
    rank = F.struct(value.alias("v"), (-F.col(order)).alias("i"))
    return scored.groupBy(key).agg(F.max_by(order, rank).alias(order), F.max_by(text, rank).alias(text))
