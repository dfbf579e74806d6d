"""Cleaning responses, building sets of them, and splitting sets by problem.

All random choices are hash order over a stable key, so any task can be recomputed and gives the
same choice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voteframe.functions import grading as g
from voteframe.functions.grading import Grader
from voteframe.functions.text import token_count
from voteframe.operators.ordering import (
    HOT_ROWS, hash_bucket, hash_row_numbers, null_safe_join, oversized, row_numbers, running_totals, sample_key,
)
from voteframe.operators.prompts import PLAIN_TEMPLATE, set_prompt
from voteframe.operators.selection import filter_by_token_length
from voteframe.session import cut_lineage

# Fixed value: problems with this many responses or fewer are dropped by cleaning.
MIN_RESPONSES = 7
SLOT_BLOCK = 4096  # slots of repeats are made in blocks, so no array grows with the number of sets


def usable_responses(df: DataFrame, token_threshold: int = 2000) -> DataFrame:
    """Rows with an answer and a token count below the threshold; absent columns skip their step."""
    if "final_answer" in df.columns:
        df = df.where(F.col("final_answer").isNotNull() & (F.col("final_answer") != ""))
    if "output_token_count" in df.columns:
        df = df.where(F.col("output_token_count") < token_threshold)
    return df


def clean_responses(df: DataFrame, token_threshold: int = 2000) -> DataFrame:
    """Usable rows of problems that keep more than seven of them."""
    usable = usable_responses(df, token_threshold)
    enough = (
        usable.groupBy("problem_id").agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > MIN_RESPONSES).select("problem_id")
    )
    return null_safe_join(usable, enough, ["problem_id"], "left_semi")


def response_count_distribution(df: DataFrame, token_threshold: int = 2000) -> DataFrame:
    """Problems per number of usable responses and whether cleaning keeps them."""
    counts = usable_responses(df, token_threshold).groupBy("problem_id").agg(
        F.count(F.lit(1)).alias("responses")
    )
    return counts.groupBy("responses").agg(F.count(F.lit(1)).alias("problems")).withColumn(
        "status", F.when(F.col("responses") > MIN_RESPONSES, "keep").otherwise("drop")
    )


def halving_sizes(size: int) -> list[int]:
    """size, size // 2, ..., 1."""
    sizes = [size]
    while sizes[-1] > 1:
        sizes.append(sizes[-1] // 2)
    return sizes


def make_sets(
    df: DataFrame, num: int, sizes: Sequence[int], fill: bool = False, seed: int = 42,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Assign responses to sets, for every set size at once and in one pass over the responses.

    Per problem and size, ``num * size`` responses are sampled without replacement in hash order.
    A problem with fewer keeps all of them in their own order; with ``fill`` random repeats are
    added up to ``num * size``. Only full sets remain. Adds set_size, set_no, slot, set_id.

    The hash order does not depend on the size, so at most ``num * max(sizes)`` responses of a
    problem are ever used (``smallest_digests``). Neither a problem's size nor ``num`` decides what a
    task holds: above ``hot_rows`` responses positions are counted over chunks of a problem. A null
    problem is a group like any other; equal (problem, response_idx) are taken in any order.
    """
    most = num * max(sizes)
    problem = ["problem_id"]
    keyed = df.withColumn(
        "__digest", sample_key(F.col("problem_id"), F.col("response_idx"), seed=seed)
    )
    if oversized(df, problem, hot_rows) is None:
        in_hash = Window.partitionBy(*problem).orderBy("__digest")
        whole = Window.partitionBy(*problem)
        # Spark applies a rank limit of up to a thousand before the shuffle as well. What is left
        # of a problem with fewer than ``most`` rows is complete, so counts below that are right.
        counted = (
            keyed.withColumn("__rank", F.row_number().over(in_hash)).where(F.col("__rank") <= most)
            .withColumns({
                "__rank": (F.col("__rank") - 1).cast("bigint"),
                "__n": F.count(F.lit(1)).over(whole),
                "__own": (F.row_number().over(whole.orderBy("response_idx")) - 1).cast("bigint"),
            })
        )
    else:
        drawn = smallest_digests(keyed, problem, "__digest", most, "__n")
        ranked = hash_row_numbers(drawn, problem, "__digest", "__rank", hot_rows)
        first = ranked.where(F.col("__rank") < most)
        counted = row_numbers(first, problem, "response_idx", "__own", hot_rows=hot_rows)
    counted = counted.drop("__digest")
    sized = counted.withColumn("set_size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    needed = F.col("set_size") * num
    parts = sized.withColumn(
        "__pos", F.when(F.col("__n") >= needed, F.col("__rank")).otherwise(F.col("__own"))
    ).drop("__rank", "__own").where(F.col("__pos") < needed)
    if fill:
        keys = ["set_size", "problem_id"]
        short = parts.where(F.col("__n") < needed)
        last, block = (needed - 1).cast("bigint"), F.col("__block") * SLOT_BLOCK
        in_block = F.sequence(F.greatest(F.col("__n"), block), F.least(last, block + (SLOT_BLOCK - 1)))
        repeats = short.where(F.col("__pos") == 0).select(
            *keys, "__n", F.explode(F.sequence(block_of(F.col("__n")), block_of(last))).alias("__block")
        ).withColumn("__slot", F.explode(in_block)).drop("__block").withColumn(
            "__pick", repeat_pick(F.col("problem_id"), F.col("__slot"), F.col("__n"), seed)
        )
        source = short.withColumnRenamed("__pos", "__pick").drop("__n")
        drawn = null_safe_join(repeats, source, [*keys, "__pick"]).withColumn("__pos", F.col("__slot"))
        parts = parts.unionByName(drawn.select(*parts.columns))
    held = F.when(F.lit(fill), needed).otherwise(F.least(needed, F.col("__n")))
    placed = parts.withColumns(
        {
            "set_no": F.floor(F.col("__pos") / F.col("set_size")),
            "slot": (F.col("__pos") % F.col("set_size")).cast("int"),
        }
    ).where(F.col("set_no") < F.floor(held / F.col("set_size")))
    set_id = F.concat(F.col("problem_id"), F.lit("_set_"), F.col("set_no").cast("string"))
    return placed.withColumn("set_id", set_id).drop("__n", "__pos")


def block_of(slot: Column) -> Column:
    return F.floor(slot / F.lit(SLOT_BLOCK)).cast("bigint")


def smallest_digests(
    df: DataFrame, keys: Sequence[str], digest: str, most: int, count: str
) -> DataFrame:
    """Rows that include the ``most`` smallest digests of each key, about twice as many at most, with
    the key's number of rows as ``count``; smaller keys stay whole.

    A row's level is the number of leading zero bits of its digest. Rows are counted per key and
    level (at most 33 counters a key, combined on the map side), and a key keeps the rows from the
    highest level on at which enough are left. That threshold is counted and not estimated, so no
    row that is needed can be missing, and nothing is ordered before most rows are gone.
    """
    keys = list(keys)
    number = F.conv(F.substring(F.col(digest), 1, 8), 16, 10).cast("bigint")
    level = F.lit(32) - F.length(F.ltrim(F.bin(number), F.lit("0")))
    levelled = df.withColumn("__level", level)
    cells = levelled.groupBy(*keys, "__level").agg(F.count(F.lit(1)).alias("__rows"))
    above = F.sum("__rows").over(Window.partitionBy(*keys).orderBy(F.desc("__level")))
    cuts = cells.withColumn("__above", above).groupBy(*keys).agg(
        F.sum("__rows").alias(count),
        F.coalesce(F.max(F.when(F.col("__above") >= most, F.col("__level"))), F.lit(0)).alias("__cut"),
    )
    kept = null_safe_join(levelled, cuts, keys).where(F.col("__level") >= F.col("__cut"))
    return kept.drop("__level", "__cut")


def repeat_pick(problem: Column, slot: Column, n: Column, seed: int = 42) -> Column:
    """Position of the response repeated in ``slot``: a hash of problem, slot and seed modulo n."""
    number = F.conv(F.substring(sample_key(problem, slot, seed=seed), 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, n)


def set_records(
    members: DataFrame, confidence_key: str = "tail_confidence",
    template: str = PLAIN_TEMPLATE, grader: Grader = g.equivalent,
) -> DataFrame:
    """One row per set: ordered solutions, the chosen score, score arrays, prompt, right answers.

    A set has ``set_size`` members, so the collected arrays are bounded.
    """
    scores = ("mean_group_confidence", "bottom_10_percent_confidence", "tail_confidence")
    answer = F.coalesce(F.col("final_answer"), F.lit(""))
    right = F.coalesce(grader(answer, F.col("ground_truth")), F.lit(False))
    member = F.struct(
        "slot", F.coalesce("content", "generated_text").alias("content"),
        answer.alias("final_answer"), F.col(confidence_key).alias("confidence"),
        "generated_text", *[F.col(s).alias(f"score_{i}") for i, s in enumerate(scores)],
    )
    sets = members.withColumn("__right", right).groupBy(
        "set_size", "problem_id", "set_no", "set_id"
    ).agg(
        F.min_by("problem_text", "slot").alias("problem_text"),
        F.min_by("ground_truth", "slot").alias("ground_truth"),
        F.array_sort(F.collect_list(member)).alias("__m"),
        F.avg(F.col("__right").cast("double")).alias("accuracy"),
    )
    items = F.col("__m")
    solution = lambda m: F.struct(
        m["content"].alias("content"), m["final_answer"].alias("final_answer"),
        F.struct(F.lit(confidence_key).alias("key"), m["confidence"].alias("value")).alias("confidence"),
    )
    field = lambda name: F.transform(items, lambda m: m[name])
    return sets.select(
        "problem_id", "problem_text", "ground_truth", "set_id", "set_size", "set_no",
        set_prompt(F.col("problem_text"), items, template, "confidence").alias("prompt"),
        F.transform(items, solution).alias("solutions"),
        F.lit(confidence_key).alias("selected_confidence_key"),
        field("confidence").alias("selected_confidence"),
        F.lit(True).alias("enable_thinking"),
        field("generated_text").alias("responses"),
        F.struct(*[field(f"score_{i}").alias(s) for i, s in enumerate(scores)]).alias(
            "confidence_scores"
        ),
        "accuracy",
    )


def classify_sets(sets: DataFrame) -> DataFrame:
    """easy where at least half of the answers are right, else hard."""
    return sets.withColumn(
        "difficulty", F.when(F.col("accuracy") >= 0.5, "easy").otherwise("hard")
    )


def mix_easy(
    sets: DataFrame, percent: float = 50, seed: int = 42
) -> DataFrame:
    """Per set size: all hard sets and floor(hard * percent / 100) easy ones in hash order, which is
    settled on the keys alone; sets without an id are taken or left together."""
    hard = sets.where(F.col("difficulty") == "hard")
    # One row per set size: as many rows as the configuration has sizes.
    quota = hard.groupBy("set_size").agg(
        F.floor(F.count(F.lit(1)) * F.lit(float(percent)) / 100).alias("__quota")
    )
    easy = sets.where(F.col("difficulty") == "easy")
    keys = easy.select("set_size", "set_id").withColumn("__digest", sample_key("set_id", seed=seed))
    placed = hash_row_numbers(keys, ["set_size"], "__digest", "__pos", chunk="always")
    chosen = placed.join(quota, "set_size").where(F.col("__pos") < F.col("__quota")).select("set_size", "set_id")
    return hard.unionByName(null_safe_join(easy, chosen, ["set_size", "set_id"], "left_semi"))


def split_by_problem(
    sets: DataFrame, fraction: float = 0.8, seed: int = 42
) -> DataFrame:
    """Add ``split``: per set size the first floor(problems * fraction) problems in hash order are
    for training, the rest for validation. All sets of a problem stay together."""
    problems = sets.select("set_size", "problem_id").distinct().withColumn(
        "__digest", sample_key("problem_id", seed=seed)
    )
    placed = running_totals(
        problems, ["set_size"], "__digest", {"__pos": F.lit(1).cast("bigint")},
        hash_bucket(problems, "__digest"), chunk="always", totals=True,
    )
    train = F.col("__pos") < F.floor(F.col("__pos_total") * F.lit(float(fraction)))
    marked = placed.select(
        "set_size", "problem_id", F.when(train, "train").otherwise("validation").alias("split")
    )
    return null_safe_join(sets, marked, ["set_size", "problem_id"])


def curate(
    df: DataFrame, size: int = 4, num: int = 4, strategy: str = "naive", percent: float = 50,
    fraction: float = 0.8, fill: bool = False, seed: int = 42,
    confidence_key: str = "tail_confidence", template: str = PLAIN_TEMPLATE,
    grader: Grader = g.equivalent,
) -> DataFrame:
    """Sets of one size, or for ``curriculum`` and ``multitask`` of the sizes size, size//2, ..., 1
    in one plan. Each size is mixed and split on its own. Write with
    ``partitionBy('set_size', 'split')`` for one output per size and split."""
    sizes = halving_sizes(size) if strategy in ("curriculum", "multitask") else [size]
    members = make_sets(df, num, sizes, fill, seed)
    # The sets are read several times below, so they are written once.
    records = cut_lineage(classify_sets(set_records(members, confidence_key, template, grader)), "sets")
    keys = ["set_size", "problem_id", "set_no"]
    slim = records.select(*keys, "set_id", "difficulty")
    marked = split_by_problem(mix_easy(slim, percent, seed), fraction, seed)
    return null_safe_join(records, marked.select(*keys, "split"), keys)


def group_solutions(
    df: DataFrame, size: int, max_groups: int | None = None, order: str = "response_idx",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number rows per problem again and cut them into consecutive full groups of ``size``; the
    remainder is dropped and at most ``max_groups`` groups remain. Adds group_idx and slot."""
    problem = ["problem_id"]
    if max_groups and oversized(df, problem, hot_rows) is None:
        # Spark applies a limit of up to a thousand before the shuffle as well.
        in_order = Window.partitionBy(*problem).orderBy(order)
        placed = df.withColumn("__rank", F.row_number().over(in_order)).where(
            F.col("__rank") <= size * max_groups
        ).withColumn("__pos", (F.col("__rank") - 1).cast("bigint")).drop("__rank")
    else:
        placed = row_numbers(df, problem, order, "__pos", hot_rows=hot_rows)
    cut = placed.withColumns(
        {"group_idx": F.floor(F.col("__pos") / size), "slot": (F.col("__pos") % size).cast("int")}
    )
    if max_groups:
        cut = cut.where(F.col("group_idx") < max_groups)
    members = F.count(F.lit(1)).over(Window.partitionBy("problem_id", "group_idx"))
    return cut.withColumn("__members", members).where(F.col("__members") == size).drop(
        "__members", "__pos"
    )


def aggregation_requests(
    df: DataFrame, size: int, max_groups: int | None, max_tokens: int,
    scores: Sequence[str], counter: Callable[[Column], Column] = token_count,
    grader: Grader = g.equivalent, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per group of a problem: ordered solutions, right answers, number of groups.

    All groups have ``size`` members; :func:`group_sizes_text` writes the problem's group sizes out
    as a comma list where a file format asks for it.
    """
    kept = filter_by_token_length(df, max_tokens, counter)
    grouped = group_solutions(kept, size, max_groups, hot_rows=hot_rows)
    right = g.is_correct_equivalent(F.col("final_answer"), F.col("ground_truth"), grader)
    # Maps cannot be sorted, so scores travel as an array until the members are in order.
    member = F.struct(
        "slot", "content", "final_answer", F.array(*[F.col(s) for s in scores]).alias("values")
    )
    names = F.array(*[F.lit(s) for s in scores])
    solution = lambda m: F.struct(
        m["content"].alias("content"), m["final_answer"].alias("final_answer"),
        F.map_from_arrays(names, m["values"]).alias("confidence_scores"),
    )
    requests = grouped.groupBy("problem_id", "group_idx").agg(
        F.min_by("problem_text", "slot").alias("problem_text"),
        F.min_by("ground_truth", "slot").alias("ground_truth"),
        F.transform(F.array_sort(F.collect_list(member)), solution).alias("solutions"),
        F.count_if(right).alias("correct_count"),
    )
    # All groups are full, so their number follows from a count that combines before the shuffle.
    full = F.floor(F.count(F.lit(1)) / size)
    full = F.least(full, F.lit(max_groups).cast("bigint")) if max_groups else full
    groups = kept.groupBy("problem_id").agg(full.alias("num_groups"))
    return null_safe_join(requests, groups, ["problem_id"])


def group_sizes_text(num_groups: Column, size: int) -> Column:
    """The sizes of a problem's groups as text, for example '4,4,4'."""
    return F.array_join(F.array_repeat(F.lit(str(size)), num_groups.cast("int")), ",")
