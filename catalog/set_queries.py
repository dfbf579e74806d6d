"""Cleaning, set building, splitting and aggregation requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import WITH_R, query, rounded
from voteframe.operators import curation as cu, prompts as pr
from voteframe.schemas import SET_VOTE_SCORES

USABLE = WITH_R + ", u as (select * from r where final_answer <> '' and output_token_count < 2000) "
NUM = 4


def members_sql(sizes: list[int], fill: bool) -> str:
    """Set membership of every response, by hash order, or own order where there are too few."""
    values = ", ".join(f"({s})" for s in sizes)
    base = (
        f", z(set_size) as (values {values}), n as (select problem_id, count(*) as n from r group by 1), "
        "sized as (select r.* exclude (pos, slot, blk), n.n, cast(z.set_size as int) as set_size from r join n using (problem_id), z), "
        "placed as (select *, case when n >= set_size * {num} then row_number() over (partition by set_size, problem_id "
        "order by md5(concat(problem_id, '|', cast(response_idx as string), '|42'))) - 1 "
        "else row_number() over (partition by set_size, problem_id order by response_idx) - 1 end as pos from sized)"
    ).replace("{num}", str(NUM))
    if not fill:
        return base + (
            f", members as (select *, pos // set_size as set_no, cast(pos % set_size as int) as slot from placed "
            f"where pos < (least(n, set_size * {NUM}) // set_size) * set_size) "
        )
    pick = (
        "cast(concat('0x', substr(md5(concat(problem_id, '|', cast(slot_no as string), '|42')), 1, 8)) as bigint) % n"
    )
    return base + (
        ", gaps as (select distinct set_size, problem_id, n, unnest(range(n, set_size * "
        f"{NUM})) as slot_no from placed where n < set_size * {NUM}), "
        f"drawn as (select set_size, problem_id, slot_no, {pick} as pick from gaps), "
        "filled as (select * from placed where pos < set_size * "
        f"{NUM} union all by name select p.* replace (d.slot_no as pos) from drawn d join placed p "
        "on p.set_size = d.set_size and p.problem_id = d.problem_id and p.pos = d.pick), "
        "members as (select *, pos // set_size as set_no, cast(pos % set_size as int) as slot from filled) "
    )


SHOWN = (
    "select problem_id, set_size, cast(set_no as bigint) as set_no, slot, concat(problem_id, '_set_', cast(set_no as string)) as set_id, response_id from members"
)


def shown(df):
    return df.select("problem_id", "set_size", "set_no", "slot", "set_id", "response_id")


@query(
    "k1_clean_responses",
    USABLE + "select event_id from u where problem_id in (select problem_id from u group by 1 having count(*) > 7)",
)
def k1(spark, sf):
    return cu.clean_responses(fx.responses(spark, sf)).select("event_id")


@query(
    "k2_response_count_distribution",
    USABLE + "select responses, count(*) as problems, case when responses > 7 then 'keep' else 'drop' end as status "
    "from (select count(*) as responses from u group by problem_id) group by 1",
)
def k2(spark, sf):
    return cu.response_count_distribution(fx.responses(spark, sf))


@query("k3_make_sets", WITH_R + members_sql([4], False) + SHOWN)
def k3(spark, sf):
    return shown(cu.make_sets(fx.responses(spark, sf), NUM, [4]))


@query("k4_fill_short_problems", WITH_R + members_sql([4], True) + SHOWN)
def k4(spark, sf):
    return shown(cu.make_sets(fx.responses(spark, sf), NUM, [4], fill=True))


RECORDS = (
    ", records as (select problem_id, set_size, set_no, concat(problem_id, '_set_', cast(set_no as string)) as set_id, "
    "avg(case when lower(trim(final_answer)) = lower(ground_truth) then 1e0 else 0e0 end) as accuracy, "
    "string_agg(final_answer, '|' order by slot) as answers, string_agg(coalesce(generated_text, '-'), '|' order by slot) as texts, "
    "string_agg(coalesce(cast(tail_confidence * 16 as bigint)::varchar, '-'), '|' order by slot) as scores, "
    "min(problem_text) as problem_text, string_agg(concat('solution', slot + 1, ':', chr(10), content, chr(10), 'final_answer: ', "
    "final_answer, chr(10), 'confidence: ', case when tail_confidence is null then 'N/A' else printf('%.4f', tail_confidence) end, chr(10)), "
    "chr(10) order by slot) as blocks from members group by 1, 2, 3, 4) "
)


def records(spark, sf, sizes):
    return cu.set_records(cu.make_sets(fx.responses(spark, sf), NUM, sizes))


@query(
    "k5_set_record",
    WITH_R + members_sql([4], False) + RECORDS + "select set_id, problem_id, set_size, answers, texts, scores, "
    "cast(set_size as int) as members, round(accuracy, 6) as accuracy from records",
)
def k5(spark, sf):
    df = records(spark, sf, [4])
    text = lambda arr: F.array_join(arr, "|", "-")
    tail = F.transform(F.col("confidence_scores.tail_confidence"), lambda x: (x * 16).cast("bigint").cast("string"))
    return rounded(
        df.select(
            "set_id", "problem_id", "set_size",
            F.array_join(F.transform("solutions", lambda s: s["final_answer"]), "|").alias("answers"),
            text(F.col("responses")).alias("texts"), text(tail).alias("scores"),
            F.size("selected_confidence").alias("members"), "accuracy",
        )
    )


PLAIN_HEAD = "'Given the following problem:', chr(10), problem_text, chr(10), 'and these solution attempts:', chr(10), blocks, chr(10)"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "k6_set_prompt",
    WITH_R + members_sql([4], False) + RECORDS + f"select set_id, concat({PLAIN_HEAD}, "
    + literal(pr.PLAIN_TEMPLATE.split("{solutions}\n")[1]) + ") as prompt from records",
)
def k6(spark, sf):
    return records(spark, sf, [4]).select("set_id", "prompt")


@query(
    "k7_classify_sets",
    WITH_R + members_sql([4], False) + RECORDS + "select set_id, case when accuracy >= 0.5e0 then 'easy' else 'hard' end as difficulty from records",
)
def k7(spark, sf):
    return cu.classify_sets(records(spark, sf, [4])).select("set_id", "difficulty")


MIXED = (
    ", graded as (select *, accuracy >= 0.5e0 as easy from records), "
    "quota as (select set_size, floor(count(*) * 50e0 / 100) as q from graded where not easy group by 1), "
    "easies as (select *, row_number() over (partition by set_size order by md5(concat(set_id, '|42'))) - 1 as p from graded where easy), "
    "mixed as (select set_size, set_id, problem_id, 'hard' as difficulty from graded where not easy union all "
    "select e.set_size, set_id, problem_id, 'easy' from easies e join quota q on e.set_size = q.set_size where e.p < q.q) "
)


@query("k8_mix_easy", WITH_R + members_sql([4], False) + RECORDS + MIXED + "select set_id, difficulty from mixed")
def k8(spark, sf):
    return cu.mix_easy(cu.classify_sets(records(spark, sf, [4]))).select("set_id", "difficulty")


SPLIT = (
    ", probs as (select distinct set_size, problem_id from {src}), ranked as (select *, row_number() over (partition by set_size "
    "order by md5(concat(problem_id, '|42'))) - 1 as p, count(*) over (partition by set_size) as n from probs) "
)


@query(
    "k9_split_by_problem",
    WITH_R + members_sql([4], False) + RECORDS + SPLIT.format(src="records")
    + "select s.set_id, case when p < floor(n * 0.8e0) then 'train' else 'validation' end as split "
    "from records s join ranked r2 on s.set_size = r2.set_size and s.problem_id = r2.problem_id",
)
def k9(spark, sf):
    return cu.split_by_problem(records(spark, sf, [4])).select("set_id", "split")


@query(
    "k10_curate_multitask",
    WITH_R + members_sql([4, 2, 1], False) + RECORDS + MIXED + SPLIT.format(src="mixed")
    + "select m.set_size, m.set_id, m.difficulty, case when p < floor(n * 0.8e0) then 'train' else 'validation' end as split "
    "from mixed m join ranked r2 on m.set_size = r2.set_size and m.problem_id = r2.problem_id",
)
def k10(spark, sf):
    df = cu.curate(fx.responses(spark, sf), 4, NUM, "multitask")
    return df.select("set_size", "set_id", "difficulty", "split")


@query(
    "k10_curate_curriculum",
    WITH_R + members_sql([4, 2, 1], False) + RECORDS + MIXED + SPLIT.format(src="mixed")
    + "select m.set_size, case when p < floor(n * 0.8e0) then 'train' else 'validation' end as split, m.difficulty, count(*) as sets "
    "from mixed m join ranked r2 on m.set_size = r2.set_size and m.problem_id = r2.problem_id group by 1, 2, 3",
)
def k10_curriculum(spark, sf):
    df = cu.curate(fx.responses(spark, sf), 4, NUM, "curriculum")
    return df.groupBy("set_size", "split", "difficulty").agg(F.count(F.lit(1)).alias("sets"))


@query(
    "k10_curate_naive",
    WITH_R + members_sql([4], False) + RECORDS + MIXED + SPLIT.format(src="mixed")
    + "select case when p < floor(n * 0.8e0) then 'train' else 'validation' end as split, m.difficulty, count(*) as sets "
    "from mixed m join ranked r2 on m.set_size = r2.set_size and m.problem_id = r2.problem_id group by 1, 2",
)
def k10_naive(spark, sf):
    df = cu.curate(fx.responses(spark, sf), 4, NUM)
    return df.groupBy("split", "difficulty").agg(F.count(F.lit(1)).alias("sets"))


GROUPED = (
    WITH_R + ", kept as (select * exclude (pos, slot, blk) from r where content <> '' and 2 + event_id % 40 < 30), "
    "numbered as (select *, row_number() over (partition by problem_id order by response_idx) - 1 as pos from kept), "
    "grouped as (select *, cast(pos // 4 as bigint) as group_idx, cast(pos % 4 as int) as slot, count(*) over (partition by problem_id, pos // 4) as c from numbered), "
    "groups as (select * from grouped where c = 4) "
)


@query("k11_group_solutions", GROUPED + "select event_id, group_idx, slot from groups where group_idx < 5")
def k11(spark, sf):
    from voteframe.functions.text import word_count
    from voteframe.operators.selection import filter_by_token_length

    kept = filter_by_token_length(fx.responses(spark, sf), 30, word_count)
    return cu.group_solutions(kept, 4, 5).select("event_id", "group_idx", "slot")


def requests(spark, sf):
    return cu.aggregation_requests(fx.responses(spark, sf), 4, 5, 30, SET_VOTE_SCORES)


REQUESTS = GROUPED + (
    ", req as (select problem_id, group_idx, count(*) filter (where is_correct) as correct_count, "
    "string_agg(final_answer, '|' order by slot) as answers from groups where group_idx < 5 group by 1, 2) "
)


@query(
    "k12_aggregation_requests",
    REQUESTS + "select problem_id, group_idx, correct_count, answers, repeat(',4', count(*) over (partition by problem_id)::int)[2:] "
    "as solution_group_sizes from req",
)
def k12(spark, sf):
    df = requests(spark, sf)
    return df.select(
        "problem_id", "group_idx", "correct_count",
        F.array_join(F.transform("solutions", lambda s: s["final_answer"]), "|").alias("answers"),
        cu.group_sizes_text(F.col("num_groups"), 4).alias("solution_group_sizes"),
    )


SUBSETS = (
    {"name": "without_confidence", "display_name": "No Confidence", "include_confidence": False, "subset_size": 0},
    {"name": "single_confidence", "subset_size": 1},
    {"name": "all_confidence", "subset_size": 9},
)
VARIANT_VALUES = (
    "(values ('without_confidence', 0), ('single_confidence__mean_group_confidence', 1), "
    "('single_confidence__lowest_group_confidence', 1), ('single_confidence__bottom_10_percent_confidence', 1), "
    "('single_confidence__tail_confidence', 1), ('all_confidence__mean_group_confidence__lowest_group_confidence__"
    "bottom_10_percent_confidence__tail_confidence', 4)) v(variant_id, metrics)"
)


@query(
    "k13_confidence_variants",
    REQUESTS + f"select problem_id, group_idx, variant_id, cast(metrics as int) as metrics from req, {VARIANT_VALUES}",
)
def k13(spark, sf):
    df = pr.with_variants(requests(spark, sf), pr.build_variants(subsets=SUBSETS))
    return df.select("problem_id", "group_idx", "variant_id", F.size("confidence_keys").alias("metrics"))


def _score(name: str, digits: int) -> str:
    return f"case when {name} is null then 'N/A' else printf('%.{digits}f', {name}) end"


def _blocks_sql(lines: str) -> str:
    return (
        "string_agg(concat('Solution ', slot + 1, ':', chr(10), content, chr(10), 'final_answer: ', final_answer"
        f"{lines}), concat(chr(10), chr(10)) order by slot)"
    )


STYLES = {
    "default": f", chr(10), 'confidence scores:', chr(10), '- Mean: ', {_score('mean_group_confidence', 4)}, chr(10), '- Tail: ', {_score('tail_confidence', 4)}",
    "without_confidence": "",
    "confidence_no_guidance": f", chr(10), 'Confidence score 1: ', {_score('mean_group_confidence', 3)}, chr(10), 'Confidence score 2: ', {_score('tail_confidence', 3)}",
    "confidence_full_guidance": f", chr(10), 'Mean Confidence score: ', {_score('mean_group_confidence', 3)}, chr(10), 'Tail Confidence score: ', {_score('tail_confidence', 3)}",
}


def _style_sql(style: str, lines: str) -> str:
    head, rest = pr.STYLE_TEMPLATES[style].split("{problem}")
    middle, end = rest.split("{solutions}")
    return (
        f"select '{style}' as style, problem_id, group_idx, concat({literal(head)}, min(problem_text), {literal(middle)}, "
        f"{_blocks_sql(lines)}, {literal(end)}) as prompt from groups where group_idx < 5 group by problem_id, group_idx"
    )


@query("k14_variant_prompt", GROUPED + " union all ".join(_style_sql(s, x) for s, x in STYLES.items()))
def k14(spark, sf):
    df = requests(spark, sf)
    keys = F.array(F.lit("mean_group_confidence"), F.lit("tail_confidence"))
    prompts = F.array(
        *[
            F.struct(F.lit(s).alias("style"), pr.variant_prompt(F.col("problem_text"), F.col("solutions"), keys, s).alias("prompt"))
            for s in STYLES
        ]
    )
    return df.select("problem_id", "group_idx", F.inline(prompts))
