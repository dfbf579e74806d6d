"""Distribution reports: summary statistics, bins, ladders and per-problem profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voteframe.functions.text import lacks_marker
from voteframe.operators.ordering import bin_index, constant_bin, exact_percentiles, null_safe_join

# Percentile lists and bin ladders of the reports. A ladder is chosen by the maximum
# value: the first whose limit is above it, else the last.
TAIL_PERCENTILES = (0.25, 0.5, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99)
PROFILE_PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
ACCURACY_PERCENTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
CLOSED_PERCENTILES = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
OUTPUT_TOKEN_EDGES = (0, 5000, 10000, 15000, 20000, 25000, 30000, 35000)
ACCURACY_EDGES = (0, 20, 40, 60, 80)
CONTENT_LADDER = (
    (500, (0, 50, 100, 150, 200, 250, 300, 350)),
    (2000, (0, 200, 400, 600, 800, 1000, 1200, 1500)),
    (None, (0, 1000, 2000, 3000, 4000, 5000, 6000, 7000)),
)
PROMPT_LADDER = (
    (1000, (0, 100, 200, 300, 400, 500, 600, 700, 800, 900)),
    (5000, (0, 500, 1000, 1500, 2000, 2500, 3000, 3500, 4000)),
    (None, (0, 1000, 2000, 3000, 4000, 5000, 6000, 7000, 8000)),
)
PROFILE_LADDER = (
    (5000, (0, 1000, 2000, 3000, 4000)),
    (15000, (0, 5000, 10000, 15000)),
    (None, (0, 5000, 10000, 15000, 20000, 25000)),
)


def present(name: str) -> Column:
    """Neither null nor NaN."""
    return F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))


def describe(
    df: DataFrame, value: str, fractions: Sequence[float] = (), keys: Sequence[str] = (),
    sample_std: bool = False, chunk: str = "auto",
) -> DataFrame:
    """n, mean, median, std, min, max and optional percentiles p<percent> of the non-null values.
    Exact; without keys the result is one row."""
    keys = list(keys)
    x = F.col(value)
    std = F.stddev_samp(x) if sample_std else F.stddev_pop(x)
    moments = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), std.alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )
    wanted = [0.5, *fractions]
    edges = exact_percentiles(df, value, wanted, keys, "__p", chunk=chunk)
    if keys:
        joined = null_safe_join(moments, edges, keys, "left")
    else:
        joined = moments.withColumn("__p", edges.select("__p").scalar())
    named = {"median": F.col("__p")[0]}
    for i, f in enumerate(fractions):
        named[f"p{round(f * 100)}"] = F.col("__p")[i + 1]
    return joined.withColumns(named).drop("__p")


def step_bin(value: Column, edges: Sequence[float]) -> Column:
    """Zero-based index of the highest edge not above ``value``; null below the first edge."""
    chain = None
    for i in range(len(edges) - 1, -1, -1):
        cond = value >= F.lit(edges[i])
        chain = F.when(cond, F.lit(i)) if chain is None else chain.when(cond, F.lit(i))
    return chain


def pick_ladder(top: float | None, ladder: Sequence[tuple]) -> Sequence[float]:
    """Edges of the ladder that the maximum ``top`` selects."""
    for limit, edges in ladder:
        if limit is None or (top is not None and top < limit):
            return edges
    raise ValueError("a ladder ends with an open limit")


def ladder_bins(df: DataFrame, value: str, ladder: Sequence[tuple]) -> DataFrame:
    """Rows per bin, with its lower edge, on the ladder chosen by the maximum (found by a first
    job)."""
    edges = pick_ladder(df.agg(F.max(value)).first()[0], ladder)
    lows = F.array(*[F.lit(e) for e in edges])
    counted = binned(df, step_bin(F.col(value), edges))
    return counted.withColumn("low", F.element_at(lows, F.col("bin") + F.lit(1)))


def binned(df: DataFrame, bins: Column, keys: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """Rows per bin; values outside every bin are left out."""
    return df.withColumn("bin", bins).where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("count"), *extra
    )


def accuracy_by_percentile(
    df: DataFrame, value: str, correct: str, fractions: Sequence[float], closed_last: bool,
    keep_empty: bool = False, keys: Sequence[str] = (),
) -> DataFrame:
    """Accuracy in the bins between percentiles of ``value``.

    Half-open bins lose the maximum; ``closed_last`` keeps it. Empty bins are skipped, or kept with
    accuracy 0.0 by ``keep_empty``. Without keys the edges are found by a first job (one row) and
    are constants of the second; with keys they are joined.
    """
    keys = list(keys)
    rows = df.where(present(value) & F.col(correct).isNotNull())
    x = F.col(value).cast("double")
    accuracy = F.avg(F.col(correct).cast("double")).alias("accuracy")
    if keys:
        edges = exact_percentiles(rows, value, fractions, keys, "edges", chunk="always")
        located = null_safe_join(rows, edges, keys)
        filled = binned(located, bin_index(x, F.col("edges"), closed_last), keys, [accuracy])
        bounds = edges.select(
            *keys, F.posexplode(F.slice("edges", 1, len(fractions) - 1)).alias("bin", "low"), "edges"
        ).withColumn("high", F.col("edges")[F.col("bin") + 1]).drop("edges")
    else:
        found = fetch_edges(rows, value, fractions)
        filled = binned(rows, constant_bin(x, found, closed_last), (), [accuracy])
        bounds = edge_table(df, found)
    out = null_safe_join(bounds, filled, [*keys, "bin"], "left" if keep_empty else "inner")
    if keep_empty:
        out = out.fillna({"count": 0, "accuracy": 0.0})
    return out


def fetch_edges(rows: DataFrame, value: str, fractions: Sequence[float]) -> list[float]:
    """Exact percentiles of the whole table as numbers: one job, one row."""
    found = exact_percentiles(rows, value, fractions).first()["percentiles"]
    return [] if found is None or found[0] is None else list(found)


def edge_table(df: DataFrame, edges: Sequence[float]) -> DataFrame:
    """One row per bin with its bounds."""
    bounds = [(i, edges[i], edges[i + 1]) for i in range(len(edges) - 1)]
    return df.sparkSession.createDataFrame(bounds, "bin int, low double, high double")


def accuracy_by_quantile_bins(
    df: DataFrame, value: str, correct: str, scores: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """Count, accuracy and mean scores in quantile bins of ``value`` (duplicate edges removed, last
    bin closed). Only rows with the value, the grade and every score take part."""
    needed = F.col(value).isNotNull() & F.col(correct).isNotNull()
    for s in scores:
        needed = needed & present(s)
    rows = df.where(needed)
    edges = sorted(set(fetch_edges(rows, value, [i / bins for i in range(bins + 1)])))
    # Without two distinct edges there is no bin, and the report is empty.
    place = constant_bin(F.col(value).cast("double"), edges, True) if len(edges) > 1 else F.lit(None)
    measures = [F.avg(F.col(correct).cast("double")).alias("accuracy"), *[F.avg(s).alias(s) for s in scores]]
    filled = binned(rows, place.cast("int"), (), measures)
    labels = [f"{int(low)}-{int(high)}" for low, high in zip(edges, edges[1:])]
    named = F.array(*[F.lit(x) for x in labels]) if labels else F.array().cast("array<string>")
    return filled.withColumn("label", F.element_at(named, F.col("bin") + F.lit(1)))


def confidence_by_correctness(df: DataFrame, score: str, correct: str) -> DataFrame:
    """Mean, population std, accuracy, and mean score when right or wrong."""
    x, c = F.col(score), F.col(correct)
    return df.where(present(score) & c.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.avg(c.cast("double")).alias("accuracy"),
        F.avg(F.when(c, x)).alias("mean_correct"), F.avg(F.when(~c, x)).alias("mean_wrong"),
    )


def confidence_histogram(
    df: DataFrame, score: str, correct: str, edges: int = 100, weighted: bool = True
) -> DataFrame:
    """Equal-width bins between the minimum and maximum, separately for right and wrong rows: as
    shares of their class, or as raw counts."""
    rows = df.where(present(score) & F.col(correct).isNotNull())
    low, high = rows.agg(F.min(score), F.max(score)).first()
    bins = edges - 1
    if low is None or high == low:
        place = F.lit(0)
    else:
        place = F.floor((F.col(score) - F.lit(low)) / F.lit(high - low) * bins)
    counted = rows.withColumn(
        "bin", F.least(place, F.lit(bins - 1)).cast("int")
    ).groupBy(correct, "bin").agg(F.count(F.lit(1)).alias("count"))
    if not weighted:
        return counted
    sizes = counted.groupBy(correct).agg(F.sum("count").alias("__class"))
    return null_safe_join(counted, sizes, [correct]).withColumn(
        "share", F.col("count") / F.col("__class")
    ).drop("__class")


def token_distribution(df: DataFrame, value: str = "output_token_count") -> DataFrame:
    """One row: statistics with sample std and eight percentiles."""
    return describe(df, value, TAIL_PERCENTILES, sample_std=True)


def token_bins(df: DataFrame, value: str = "output_token_count") -> DataFrame:
    """Rows per 5000-token bin, open above 35000."""
    return binned(df, step_bin(F.col(value), OUTPUT_TOKEN_EDGES)).withColumn(
        "low", F.element_at(F.array(*[F.lit(e) for e in OUTPUT_TOKEN_EDGES]), F.col("bin") + 1)
    )


def positive_statistics(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and mean of all values, and statistics of those above zero (population std)."""
    every = df.groupBy(*keys).agg(
        F.count(value).alias("total"), F.avg(value).alias("mean_all"),
        F.count_if(F.col(value) > 0).alias("positive"),
    )
    above = describe(df.where(F.col(value) > 0), value, TAIL_PERCENTILES, keys).drop("n")
    if keys:
        return null_safe_join(every, above, list(keys), "left")
    packed = above.select(F.struct(*above.columns).alias("s")).scalar()
    return every.withColumn("s", packed).select("total", "mean_all", "positive", "s.*")


def adaptive_bins(df: DataFrame, value: str, ladder: Sequence[tuple] = CONTENT_LADDER) -> DataFrame:
    """Rows per bin of the ladder chosen by the maximum, over values above zero."""
    return ladder_bins(df.where(F.col(value) > 0), value, ladder)


def prompt_token_summary(
    df: DataFrame, value: str = "prompt_token_count", split: str = "split"
) -> DataFrame:
    """Per split and over all: samples, and statistics of the values above zero."""
    both = df.select(value, F.explode(F.array(F.col(split), F.lit("all"))).alias("dataset"))
    samples = both.groupBy("dataset").agg(F.count(F.lit(1)).alias("samples"))
    stats = describe(both.where(F.col(value) > 0), value, (0.95, 0.99), ["dataset"], chunk="always").drop("n")
    return null_safe_join(samples, stats, ["dataset"], "left")


def problem_profile(
    df: DataFrame, total: Column, correct: str = "is_correct", key: str = "problem_id"
) -> DataFrame:
    """Per problem: responses, those at the largest token total of the table, those lacking the
    closing marker, accuracy in percent, prompt length and mean output tokens."""
    counted = df.withColumn("__total", total)
    top = df.select(total.alias("t")).agg(F.max("t")).scalar()
    return counted.withColumn("__top", top).groupBy(key).agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if(F.col("__total") == F.col("__top")).alias("at_max"),
        F.count_if(lacks_marker(F.col("generated_text"))).alias("no_marker"),
        (F.avg(F.col(correct).cast("double")) * 100).alias("accuracy_pct"),
        F.min_by(F.length("problem_text"), "response_idx").alias("prompt_length"),
        F.avg("output_token_count").alias("mean_output_tokens"),
    )


PROFILE_MEASURES = (
    "responses", "at_max", "no_marker", "accuracy_pct", "prompt_length", "mean_output_tokens",
)


def problem_profile_summary(profile: DataFrame) -> DataFrame:
    """Statistics of every profile measure over problems, in long form."""
    long = profile.select(
        *[F.col(m).cast("double").alias(m) for m in PROFILE_MEASURES]
    ).unpivot([], list(PROFILE_MEASURES), "measure", "value")
    return describe(long, "value", PROFILE_PERCENTILES, ["measure"], chunk="always")


def profile_count_histogram(profile: DataFrame, measure: str) -> DataFrame:
    """Problems per value of a count measure, their share and mean prompt length."""
    total = profile.agg(F.count(F.lit(1))).scalar()
    return profile.groupBy(F.col(measure).alias("value")).agg(
        F.count(F.lit(1)).alias("problems"), F.avg("prompt_length").alias("mean_prompt_length")
    ).withColumn("pct", F.col("problems") / total * 100)


def profile_accuracy_bins(profile: DataFrame) -> DataFrame:
    """Problems per 20 percent of accuracy; the last bin takes 100."""
    return binned(profile, step_bin(F.col("accuracy_pct"), ACCURACY_EDGES))


def profile_token_bins(profile: DataFrame) -> DataFrame:
    """Problems per bin of mean output tokens on the ladder chosen by the maximum."""
    return ladder_bins(profile, "mean_output_tokens", PROFILE_LADDER)


def flag_truncated(
    df: DataFrame, max_tokens: int, tokens: str = "generated_token_count"
) -> DataFrame:
    """Mark responses within one percent of the token limit."""
    return df.withColumn("truncated", F.col(tokens) >= F.lit(max_tokens) * F.lit(0.99))


def truncation_report(
    flagged: DataFrame, correct: str = "is_correct", content_tokens: str = "content_token_count",
    key: str = "problem_id",
) -> DataFrame:
    """Per problem: truncated, total and right responses, accuracy and mean content tokens."""
    return flagged.groupBy(key).agg(
        F.count_if("truncated").alias("truncated"), F.count(F.lit(1)).alias("total"),
        F.count_if(correct).alias("correct"), F.avg(content_tokens).alias("mean_content_tokens"),
    ).withColumn("accuracy", F.col("correct") / F.col("total"))


def truncation_totals(report: DataFrame) -> DataFrame:
    """Problems with a truncated response, and responses split into all, kept and excluded."""
    return report.agg(
        F.count(F.lit(1)).alias("problems"),
        F.count_if(F.col("truncated") > 0).alias("problems_with_truncated"),
        F.sum("total").alias("responses"),
        F.sum("truncated").alias("excluded"),
        F.sum(F.col("total") - F.col("truncated")).alias("kept"),
    )


def token_and_accuracy_stats(
    flagged: DataFrame, correct: str = "is_correct", tokens: str = "content_token_count"
) -> DataFrame:
    """Statistics of all responses and of the kept ones; percentiles for the kept only; 0 if empty."""
    kept = F.when(~F.col("truncated"), F.lit("kept"))
    both = flagged.select(
        F.col(tokens), F.col(correct),
        F.explode(F.array_compact(F.array(F.lit("all"), kept))).alias("part"),
    )
    stats = describe(both, tokens, PROFILE_PERCENTILES, ["part"], chunk="always")
    grades = both.groupBy("part").agg(
        F.avg(F.col(correct).cast("double")).alias("accuracy"),
        F.count_if(correct).alias("correct"), F.count(F.lit(1)).alias("total"),
    )
    parts = flagged.sparkSession.createDataFrame([("all",), ("kept",)], "part string")
    out = parts.join(stats, "part", "left").join(grades, "part", "left").drop("n").fillna(0)
    for f in PROFILE_PERCENTILES:
        name = f"p{round(f * 100)}"
        out = out.withColumn(name, F.when(F.col("part") == "kept", F.col(name)))
    return out


def solution_lengths(
    df: DataFrame, cap: int = 32000, tokens: str = "token_count", key: str = "problem_id"
) -> DataFrame:
    """Per problem: responses, those within the cap, and sum, mean, max, min of their tokens.
    ``excluded`` marks problems whose sum is above the cap."""
    fits = F.when(F.col(tokens) <= cap, F.col(tokens))
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_solutions"), F.count(fits).alias("kept_solutions"),
        F.coalesce(F.sum(fits), F.lit(0)).alias("sum_tokens"),
        F.coalesce(F.avg(fits), F.lit(0.0)).alias("avg_tokens"),
        F.coalesce(F.max(fits), F.lit(0)).alias("max_tokens"),
        F.coalesce(F.min(fits), F.lit(0)).alias("min_tokens"),
    ).withColumn("excluded", F.col("sum_tokens") > cap)


def solution_length_report(
    df: DataFrame, cap: int = 32000, tokens: str = "token_count", key: str = "problem_id"
) -> DataFrame:
    """One row over the problems that are not excluded; the median is the upper one."""
    from voteframe.operators.ordering import value_counts

    lengths = solution_lengths(df, cap, tokens, key)
    keep = lengths.where(~F.col("excluded")).select(key)
    rows = df.where(F.col(tokens) <= cap).join(keep, key, "left_semi")
    cells = value_counts(rows, [], tokens)
    middle = F.floor(F.col("__below_total") / 2)
    median = cells.where(
        (F.col("__below") <= middle) & (middle < F.col("__below") + F.col("__n"))
    ).agg(F.max(tokens))
    problems = lengths.agg(
        F.struct(F.count(F.lit(1)).alias("problems"), F.count_if("excluded").alias("excluded"))
    ).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("total_solutions"),
        F.coalesce(F.avg(tokens), F.lit(0.0)).alias("avg_tokens"),
        F.coalesce(F.max(tokens), F.lit(0)).alias("max_tokens"),
        F.coalesce(F.min(tokens), F.lit(0)).alias("min_tokens"),
    ).withColumn("p", problems).withColumn(
        "median_tokens", F.coalesce(median.scalar(), F.lit(0))
    ).select(
        F.col("p.problems").alias("total_problems"),
        (F.col("p.problems") - F.col("p.excluded")).alias("kept_problems"),
        F.col("p.excluded").alias("excluded_problems"),
        "total_solutions", "avg_tokens", "max_tokens", "min_tokens", "median_tokens",
    )


def run_report(
    df: DataFrame, max_tokens: int, tokens: str = "output_token_count", key: str = "problem_id"
) -> DataFrame:
    """Responses, problems, tokens (null as 0) and responses exactly at the limit."""
    t = F.coalesce(F.col(tokens), F.lit(0))
    per_problem = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(t).alias("s"), F.min(t).alias("lo"),
        F.max(t).alias("hi"), F.count_if(t == max_tokens).alias("at_limit"),
    )
    return per_problem.agg(
        F.sum("n").alias("responses"), F.count(F.lit(1)).alias("problems"),
        F.try_divide(F.sum("n"), F.count(F.lit(1))).alias("responses_per_problem"),
        F.sum("s").alias("tokens"), F.try_divide(F.sum("s"), F.sum("n")).alias("mean_tokens"),
        F.min("lo").alias("min_tokens"), F.max("hi").alias("max_tokens"),
        F.sum("at_limit").alias("at_limit"),
    )
