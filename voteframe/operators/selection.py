"""Row selection, prompts of problems, shards, completions and token totals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voteframe.functions import confidence, logprobs as lp
from voteframe.functions.text import token_count
from voteframe.operators.ordering import row_numbers, sample_key, with_positions
from voteframe.schemas import SCORE_NAMES

# Fixed value: the instruction appended to every problem.
BOXED_INSTRUCTION = "Please reason step by step, and put your final answer within \\boxed{}."


def build_prompt(problem: Column, instruction: str = BOXED_INSTRUCTION) -> Column:
    """Problem text, a blank line, the instruction."""
    return F.concat(problem, F.lit("\n\n"), F.lit(instruction))


def sample_problems(
    df: DataFrame, n: int, key: str = "problem_id", order: str | None = None, seed: int = 42
) -> DataFrame:
    """``n`` rows without replacement, in hash order of ``key``; all rows if ``n`` is not positive
    or at least the table size. With ``order`` the result keeps the source order."""
    if n <= 0:
        return df if order is None else df.orderBy(order)
    keyed = df.withColumn("__digest", sample_key(key, seed=seed))
    # A sorted limit keeps n rows per task and n rows in all; it never ranks the whole table.
    picked = keyed.orderBy("__digest", key).limit(n).drop("__digest")
    return picked if order is None else picked.orderBy(order)


def shard(df: DataFrame, total: int, order: str, name: str = "shard") -> DataFrame:
    """Round-robin shard number by position in ``order``."""
    placed = row_numbers(df, [], order, "__pos")
    return placed.withColumn(name, (F.col("__pos") % total).cast("int")).drop("__pos")


def pending(problems: DataFrame, done: DataFrame, key: str = "problem_id") -> DataFrame:
    """Rows whose key has not been processed yet."""
    return problems.join(done.select(key).distinct(), key, "left_anti")


def explode_completions(df: DataFrame, completions: str = "completions") -> DataFrame:
    """One row per completion with its index and response id."""
    others = [c for c in df.columns if c != completions]
    rows = df.select(*others, F.posexplode(completions).alias("response_idx", "generated_text"))
    rid = F.concat(F.col("problem_id"), F.lit("_resp_"), F.col("response_idx").cast("string"))
    return rows.withColumn("response_id", rid)


def total_tokens(df: DataFrame, fill_null: bool = True) -> Column:
    """Existing total, else output plus prompt tokens, else output tokens. ``fill_null`` counts a
    missing part as 0; without it a missing part makes the total null."""
    if "total_token_count" in df.columns:
        return F.col("total_token_count")
    output = F.col("output_token_count")
    if "prompt_token_count" not in df.columns:
        return output
    prompt = F.col("prompt_token_count")
    if fill_null:
        return F.coalesce(output, F.lit(0)) + F.coalesce(prompt, F.lit(0))
    return output + prompt


def nest_by_problem(
    df: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("problem_id",),
    order: str = "response_idx", name: str = "solutions", block: int = 4096,
) -> DataFrame:
    """Responses as ordered arrays: one row per problem and ``block`` consecutive responses, with
    ``start``, the position of the first of them.

    A problem of usual size is one row with start 0; a huge one becomes several rows, so no array
    and no task grows with the problem. Readers add ``start`` to the place in the array.
    """
    item = F.struct(F.col(order).alias("__pos"), *fields)
    ordered = F.array_sort(F.collect_list(item))
    plain = F.transform(ordered, lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    numbered = with_positions(df, keys, order, "__place")
    blocked = numbered.withColumn("start", F.floor(F.col("__place") / block) * block)
    return blocked.groupBy(*keys, "start").agg(plain.alias(name))


def ensure_confidence_columns(
    df: DataFrame, group: int = confidence.DEFAULT_GROUP, scorer: str = "sliding"
) -> DataFrame:
    """Add only the score columns that are missing, from ``logprobs``; empty input scores 0.0."""
    names = SCORE_NAMES if scorer == "sliding" else tuple(n for n in SCORE_NAMES if n != "head_confidence")
    missing = [n for n in names if n not in df.columns]
    if not missing:
        return df
    raw = F.col("logprobs")
    if scorer == "tumbling":
        scores = confidence.tumbling_confidence(lp.token_confidence(raw), group)
    else:
        scores = confidence.all_confidence(raw, group, "zero")
    scored = df.withColumn("__scores", scores)
    empty = F.coalesce(F.size("logprobs"), F.lit(0)) <= 0
    added = {
        n: F.when(empty, F.lit(0.0)).otherwise(F.col("__scores")[n]) for n in missing
    }
    return scored.withColumns(added).drop("__scores")


def cap_prompt_length(df: DataFrame, max_tokens: int, name: str = "prompt_token_count") -> DataFrame:
    """Keep prompts of at most ``max_tokens``."""
    return df.where(F.col(name) <= max_tokens)


def capped_prompt_report(
    df: DataFrame, max_tokens: int, split: str = "split", name: str = "prompt_token_count"
) -> DataFrame:
    """Per split: rows before, kept and removed by the cap."""
    kept = F.count_if(F.col(name) <= max_tokens)
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("before"),
        kept.alias("kept"),
        (F.count(F.lit(1)) - kept).alias("removed"),
    )


def filter_by_token_length(
    df: DataFrame, max_tokens: int, counter: Callable[[Column], Column] = token_count,
    content: str = "content",
) -> DataFrame:
    """Drop rows without content, count the tokens of the rest, keep counts below ``max_tokens``."""
    filled = df.where(F.coalesce(F.col(content), F.lit("")) != "")
    return filled.withColumn("token_count", counter(F.col(content))).where(
        F.col("token_count") < max_tokens
    )


