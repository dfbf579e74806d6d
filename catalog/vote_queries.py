"""Voting, pass@k and method comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import ORACLES, WITH_R, query, rounded
from voteframe.functions import grading as g
from voteframe.operators import grading as og, methods as om, passk as pk, voting as v
from voteframe.schemas import SET_VOTE_SCORES

BY = ["dataset", "model", "problem_id"]


# Winner per problem for a vote weight, ties to the answer seen first.
def winners(weight: str, answer: str = "nullif(trim(final_answer), '')", source: str = "r") -> str:
    return (
        "(select p.problem_id, p.ground_truth, coalesce(w.answer, '') as answer, "
        "coalesce(lower(w.answer) = lower(p.ground_truth), false) as ok from "
        f"(select distinct problem_id, ground_truth from {source}) p left join "
        f"(select problem_id, answer from (select problem_id, {answer} as answer, {weight} as s, "
        f"min(response_idx) as i from {source} group by 1, 2) where answer is not null qualify row_number() "
        "over (partition by problem_id order by s desc, i) = 1) w using (problem_id))"
    )


COUNT = "count(*)"
BOTTOM = "sum(coalesce(bottom_10_percent_confidence, 0))"
LOWEST = "sum(coalesce(lowest_group_confidence, 0))"
TAIL = "sum(coalesce(tail_confidence, 0))"
VOTED = (
    WITH_R + f", m as {winners(COUNT)}, b as {winners(BOTTOM)}, l as {winners(LOWEST)}, t as {winners(TAIL)}, "
    "x as (select r.event_id, r.problem_id, r.is_correct as e, m.ok as mo, b.ok as bo, l.ok as lo, t.ok as ta "
    "from r join m using (problem_id) join b using (problem_id) join l using (problem_id) join t using (problem_id)) "
)


@query(
    "v1_majority_vote",
    WITH_R + f"select problem_id, ground_truth, answer as majority_answer, ok as is_correct_majority from {winners(COUNT)}",
)
def v1(spark, sf):
    return v.majority_vote(fx.responses(spark, sf))


@query(
    "v2_weighted_vote",
    WITH_R + f"select problem_id, ground_truth, answer as weighted_answer, ok as is_correct_weighted from {winners(TAIL)}",
)
def v2(spark, sf):
    return v.weighted_vote(fx.responses(spark, sf), "tail_confidence")


@query(
    "v2_weighted_vote_all",
    WITH_R + f"select b.problem_id, b.answer as weighted_answer_bottom10, l.answer as weighted_answer_lowest, "
    f"t.answer as weighted_answer_tail from {winners(BOTTOM)} b join {winners(LOWEST)} l using (problem_id) "
    f"join {winners(TAIL)} t using (problem_id)",
)
def v2_all(spark, sf):
    votes = v.problem_votes(fx.responses(spark, sf))
    return votes.select("problem_id", *[c for c in votes.columns if c.startswith("weighted_answer")])


def voted(spark, sf):
    """Graded responses with vote flags."""
    df = fx.responses(spark, sf)
    a, b = F.col("final_answer"), F.col("ground_truth")
    graded = df.withColumns(
        {"is_correct_exact": g.is_correct_exact(a, b), "is_correct_equivalent": g.is_correct_equivalent(a, b)}
    )
    return v.attach_votes(graded, v.problem_votes(df))


@query(
    "v3_attach_votes",
    VOTED + "select event_id, mo as is_correct_majority, bo as is_correct_weighted_bottom10, "
    "lo as is_correct_weighted_lowest, ta as is_correct_weighted_tail from x",
)
def v3(spark, sf):
    flags = [c for c in om.ALL_METHODS if "weighted" in c or "majority" in c]
    return voted(spark, sf).select("event_id", *flags)


def set_sql(sizes: list[int], scores: tuple[str, ...]) -> str:
    """Long table of set votes per dataset, model and problem."""
    size_list = ", ".join(f"({s})" for s in sizes)
    weights = {"majority_voting": "1e0", **{s: f"coalesce({s}, 0)" for s in scores}}
    long = " union all ".join(
        f"select dataset, model, problem_id, response_idx, final_answer, is_correct, '{m}' as method, {w} as w from r"
        for m, w in weights.items()
    )
    return (
        f", z(set_size) as (values {size_list}), n as (select problem_id, count(*) as n from r group by 1), "
        f"y as ({long}), "
        "sets as (select dataset, model, problem_id, method, set_size, response_idx // set_size as set_no, final_answer, "
        "bool_or(is_correct) as ok, sum(w) as s, min(response_idx) as i from y join n using (problem_id), z "
        "where response_idx < (n // set_size) * set_size group by 1, 2, 3, 4, 5, 6, 7), "
        "best as (select dataset, model, problem_id, method, set_size, set_no, ok from sets where final_answer <> '' "
        "qualify row_number() over (partition by problem_id, method, set_size, set_no order by s desc, i) = 1), "
        "votes as (select s.dataset, s.model, s.problem_id, s.method, s.set_size, count(*) filter (where b.ok) as correct_count, "
        "count(*) as total_sets from (select distinct dataset, model, problem_id, method, set_size, set_no from sets) s "
        "left join best b using (dataset, model, problem_id, method, set_size, set_no) group by 1, 2, 3, 4, 5) "
    )


@query(
    "v4_set_majority_vote",
    WITH_R + set_sql([2, 4, 8], ()) + "select problem_id, set_size, correct_count, total_sets, "
    "round(correct_count / total_sets, 6) as accuracy from votes",
)
def v4(spark, sf):
    df = v.set_votes(fx.responses(spark, sf), [2, 4, 8])
    return rounded(df.drop("method"))


@query(
    "v5_set_weighted_vote",
    WITH_R + set_sql([2, 4, 8], SET_VOTE_SCORES) + "select problem_id, method, set_size, correct_count, total_sets, "
    "round(correct_count / total_sets, 6) as accuracy from votes",
)
def v5(spark, sf):
    return rounded(v.set_votes(fx.responses(spark, sf), [2, 4, 8], SET_VOTE_SCORES))


def fixed16_sql(scores: tuple[str, ...]) -> str:
    weights = {"majority_voting": "1e0", **{s: f"coalesce({s}, 0)" for s in scores}}
    long = " union all ".join(
        f"select problem_id, response_idx, final_answer, lower(trim(final_answer)) = lower(ground_truth) as ok0, "
        f"'{m}' as method, {w} as w from r where response_idx < 16"
        for m, w in weights.items()
    )
    return (
        f", z(set_size) as (values (2), (4), (8), (16)), y as ({long}), "
        "cells as (select problem_id, method, set_size, response_idx // set_size as set_no, final_answer, "
        "bool_or(ok0) as ok, sum(w) as s, min(response_idx) as i from y, z group by 1, 2, 3, 4, 5), "
        "best as (select problem_id, method, set_size, ok from cells qualify row_number() over "
        "(partition by problem_id, method, set_size, set_no order by s desc, i) = 1) "
        "select problem_id, method, set_size, count(*) filter (where ok) as correct_count, "
        "cast(16 // set_size as bigint) as total_sets, "
        "round(count(*) filter (where ok) / (16e0 / set_size), 6) as accuracy from best group by 1, 2, 3"
    )


@query("v6_set_vote_fixed16", WITH_R + fixed16_sql(SET_VOTE_SCORES))
def v6(spark, sf):
    return rounded(v.set_votes_fixed16(fx.responses(spark, sf), SET_VOTE_SCORES).drop("ground_truth"))


@query(
    "v7_pass_at_k",
    WITH_R + ", n as (select problem_id, count(*) as n, min(response_idx) filter (where is_correct) as f from r group by 1) "
    "select problem_id, cast(k as int) as k, cast(case when f < k then 1 else 0 end as double) as pass_at_k "
    "from n, (select unnest([1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,32]) as k) where k <= n",
)
def v7(spark, sf):
    return pk.pass_at_k(fx.responses(spark, sf))


@query(
    "v8_pass_at_k_fixed",
    WITH_R + "select problem_id, cast(coalesce(max(case when is_correct and response_idx < 1 then 1 end), 0) as double) "
    "as pass_at_1, cast(coalesce(max(case when is_correct and response_idx < 16 then 1 end), 0) as double) as pass_at_4, "
    "cast(coalesce(max(case when is_correct and response_idx < 16 then 1 end), 0) as double) as pass_at_16 "
    "from r group by 1",
)
def v8(spark, sf):
    return pk.pass_at_k_fixed(fx.responses(spark, sf))


@query(
    "v9_pass_at_k_list",
    WITH_R + ", p as (select problem_id, min(response_idx) filter (where is_correct) as f from r group by 1) "
    "select cast(k as int) as k, round(avg(case when f < k then 1e0 else 0e0 end), 6) as pass_at_k "
    "from p, (select unnest([1, 5, 10]) as k) group by 1",
)
def v9(spark, sf):
    from voteframe.operators.selection import nest_by_problem

    df = fx.responses(spark, sf)
    nested = nest_by_problem(df, ["final_answer", "ground_truth"])
    lists = nested.select(
        "problem_id", "start", F.transform("solutions", lambda s: s["final_answer"]).alias("predictions"),
        F.col("solutions")[0]["ground_truth"].alias("ground_truth"),
    )
    return rounded(pk.pass_at_k_list(lists, start="start"))


@query(
    "v10_adaptive_sizes",
    WITH_R + ", n as (select problem_id, count(*) as n from r group by 1) "
    "select problem_id, cast(k as int) as k, k > 1 as is_set_size from n, "
    "(select unnest([1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,32]) as k) where k <= n",
)
def v10(spark, sf):
    n = fx.responses(spark, sf).groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = n.withColumn("k", F.explode(pk.adaptive_sizes(F.col("n"))))
    return sizes.select("problem_id", "k", F.array_contains(pk.adaptive_sizes(F.col("n"), 2), F.col("k")).alias("is_set_size"))


ALL_SIZES = [*range(2, 17), 32]
METRICS = (
    set_sql(ALL_SIZES, SET_VOTE_SCORES) + ", passes as (select dataset, model, problem_id, count(*) as n, "
    "min(response_idx) filter (where is_correct) as f from r group by 1, 2, 3), "
    "metrics as (select dataset, model, metric, cast(size as int) as size, avg(value) as value, count(*) as problems from ("
    "select dataset, model, 'pass_at_k' as metric, k as size, case when f < k then 1e0 else 0e0 end as value from passes, "
    "(select unnest([1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,32]) as k) where k <= n union all "
    "select dataset, model, method, set_size, correct_count / total_sets from votes) group by 1, 2, 3, 4) "
)


@query(
    "v11_evaluate_metrics",
    WITH_R + METRICS + "select dataset, model, metric, size, round(value, 6) as value, problems from metrics",
)
def v11(spark, sf):
    return rounded(pk.evaluate_metrics(fx.responses(spark, sf), SET_VOTE_SCORES))


@query(
    "v12_overall_summary",
    WITH_R + METRICS + "select model, metric, size, round(avg(value), 6) as value, count(*) as datasets from metrics group by 1, 2, 3",
)
def v12(spark, sf):
    return rounded(pk.overall_summary(pk.evaluate_metrics(fx.responses(spark, sf), SET_VOTE_SCORES)))


MEAN7 = (
    "(mean_group_confidence + bottom_10_percent_confidence + tail_confidence + head_confidence "
    "+ lowest_group_confidence + top_10_percent_confidence + highest_group_confidence) / 7"
)


@query(
    "v13_best_by_confidence",
    WITH_R + ", s as (select problem_id, coalesce(generated_text, '') as best_text, response_idx, "
    f"{MEAN7} as best_score from r) select p.problem_id, coalesce(best_text, '') as best_text, "
    "round(best_score, 6) as best_score from (select distinct problem_id from r) p left join "
    "(select * from s where best_score is not null qualify row_number() over "
    "(partition by problem_id order by best_score desc, response_idx) = 1) using (problem_id)",
)
def v13(spark, sf):
    from voteframe.schemas import SCORE_NAMES

    return rounded(v.best_by_confidence(fx.responses(spark, sf), SCORE_NAMES))


# Temperature above 0: the first response whose running share of softmax mass passes a hashed draw.
@query(
    "v14_softmax_sample",
    WITH_R + ", s as (select problem_id, response_idx, (cast(cast(concat('0x', substr(md5(concat(problem_id, '|', "
    "cast(response_idx as string), '|42')), 1, 13)) as bigint) as double) + 0.5e0) / 4503599627370496e0 as u, tail_confidence as c "
    "from r where tail_confidence is not null) select problem_id, response_idx from s "
    "qualify row_number() over (partition by problem_id order by c / 2e0 - ln(-ln(u)) desc, response_idx) = 1",
)
def v14(spark, sf):
    df = v.softmax_sample(fx.responses(spark, sf), "tail_confidence", 2.0)
    return df.select("problem_id", "response_idx")


@query(
    "v14_softmax_argmax",
    WITH_R + "select problem_id, response_idx from r where tail_confidence is not null qualify row_number() over "
    "(partition by problem_id order by tail_confidence desc, response_idx) = 1",
)
def v14_argmax(spark, sf):
    df = v.softmax_sample(fx.responses(spark, sf), "tail_confidence", 0.0)
    return df.select("problem_id", "response_idx")


def _comparison_sql(e: str, q: str) -> str:
    """Accuracy rows; answers come from the text, so votes are over expected_answer."""
    parts = [f"select 'exact' as method, 'response' as unit, count(*) filter (where {e}) as correct, count(*) as total from x",
             f"select 'equivalent', 'response', count(*) filter (where {q}), count(*) from x"]
    parts += [
        f"select '{name}', 'problem', count(*) filter (where ok), count(*) from {source}"
        for name, source in (("majority", "m"), ("weighted_bottom10", "b"), ("weighted_lowest", "l"), ("weighted_tail", "t"))
    ]
    return "select *, round(correct / total, 6) as accuracy from (" + " union all ".join(parts) + ")"


BOXED_ANSWER = "nullif(expected_answer, '')"
TEXT_VOTES = (
    WITH_R + f", m as {winners(COUNT, BOXED_ANSWER)}, b as {winners(BOTTOM, BOXED_ANSWER)}, "
    f"l as {winners(LOWEST, BOXED_ANSWER)}, t as {winners(TAIL, BOXED_ANSWER)}, "
    "x as (select expected_answer <> '' and lower(expected_answer) = lower(ground_truth) as ok from r) "
)


@query("v15_method_comparison", TEXT_VOTES + _comparison_sql("ok", "ok"))
def v15(spark, sf):
    parsed = og.parse_and_grade(
        fx.responses(spark, sf).drop("final_answer", "content", "is_correct")
    )
    return rounded(om.method_comparison(v.attach_votes(parsed, v.problem_votes(parsed))))


def _pairs() -> str:
    flags = {"exact": "e", "equivalent": "e", "majority": "mo", "weighted_bottom10": "bo", "weighted_lowest": "lo", "weighted_tail": "ta"}
    pairs = [("exact", "equivalent"), ("majority", "weighted_bottom10"), ("majority", "weighted_lowest"), ("majority", "weighted_tail")]
    named = [(a, b, flags[a], flags[b]) for a, b in pairs] + [("bottom10", "lowest", "bo", "lo")]
    out = []
    for a, b, x, y in named:
        out += [
            f"count(*) filter (where {x} and {y}) as {a}_{b}_both",
            f"count(*) filter (where not {x} and not {y}) as {a}_{b}_neither",
            f"count(*) filter (where {x} and not {y}) as {a}_{b}_only_{a}",
            f"count(*) filter (where not {x} and {y}) as {a}_{b}_only_{b}",
        ]
    return ", ".join(out)


@query(
    "v16_method_agreement",
    VOTED + "select count(*) as total, count(*) filter (where e and mo and bo and lo and ta) as all_correct, "
    "count(*) filter (where not e and not mo and not bo and not lo and not ta) as all_wrong, "
    + _pairs() + ", count(*) filter (where bo and lo and ta) as weighted_all, "
    "count(*) filter (where not bo and not lo and not ta) as weighted_none, "
    "count(*) filter (where bo and not lo and not ta) as weighted_only_bottom10, "
    "count(*) filter (where not bo and lo and not ta) as weighted_only_lowest, "
    "count(*) filter (where not bo and not lo and ta) as weighted_only_tail, "
    "count(*) filter (where bo and lo and not ta) as weighted_bottom10_lowest, "
    "count(*) filter (where bo and not lo and ta) as weighted_bottom10_tail, "
    "count(*) filter (where not bo and lo and ta) as weighted_lowest_tail from x",
)
def v16(spark, sf):
    return om.method_agreement(voted(spark, sf))


@query(
    "v17_problem_level_comparison",
    VOTED + ", p as (select problem_id, bool_or(e) as e, bool_or(mo) as mo, bool_or(bo) as bo, bool_or(lo) as lo, "
    "bool_or(ta) as ta from x group by 1) select count(*) as problems, count(*) filter (where e) as exact_correct, "
    "count(*) filter (where e) as equivalent_correct, count(*) filter (where mo) as majority_correct, "
    "count(*) filter (where bo) as weighted_bottom10_correct, count(*) filter (where lo) as weighted_lowest_correct, "
    "count(*) filter (where ta) as weighted_tail_correct, count(*) filter (where e and mo and bo and lo and ta) as all_correct, "
    "count(*) filter (where not e and not mo and not bo and not lo and not ta) as all_wrong from p",
)
def v17(spark, sf):
    return om.problem_level_comparison(voted(spark, sf))


def rewarded(spark, sf):
    return fx.responses(spark, sf).withColumn("reward", F.col("is_correct").cast("double"))


@query(
    "v18_group_advantages",
    WITH_R + ", g as (select event_id, cast(is_correct as int) * 1e0 as reward, problem_id, response_idx // 5 as grp from r) "
    "select event_id, round((reward - avg(reward) over w) / (stddev_pop(reward) over w + 1e-8), 6) as advantage from g "
    "window w as (partition by problem_id, grp)",
)
def v18(spark, sf):
    return rounded(pk.group_advantages(rewarded(spark, sf), 5).select("event_id", "advantage"))


@query(
    "v19_group_statistics",
    WITH_R + ", g as (select cast(is_correct as int) * 1e0 as reward, problem_id, response_idx // 8 as group_no from r) "
    "select problem_id, cast(group_no as bigint) as group_no, round(avg(reward), 6) as group_mean, "
    "round(stddev_pop(reward), 6) as group_std, round((select avg(reward) from g), 6) as overall_mean, "
    "round((select stddev_pop(reward) from g), 6) as overall_std from g group by 1, 2 having count(*) = 8",
)
def v19(spark, sf):
    return rounded(pk.group_statistics(rewarded(spark, sf), 8))


RESULTS = (
    WITH_R + ", a as (select problem_id, response_idx, final_answer, ground_truth, concat('agg_', cast(blk % 2 as string)) as aggregator, "
    "concat('variant_', cast(slot as string)) as variant_id, case when event_id % 17 = 0 then null "
    "when event_id % 5 = 0 then not is_correct else is_correct end as is_correct from r) "
)


def results(spark, sf):
    """Aggregated answers with grades, some of them still missing."""
    return fx.responses(spark, sf).select(
        "event_id", "problem_id", "final_answer", "ground_truth",
        F.concat(F.lit("agg_"), F.expr("blk % 2").cast("string")).alias("aggregator"),
        F.concat(F.lit("variant_"), F.col("slot").cast("string")).alias("variant_id"),
        F.expr("case when event_id % 17 = 0 then null when event_id % 5 = 0 then not is_correct else is_correct end").alias("is_correct"),
    )


@query(
    "v20_aggregation_summary",
    RESULTS + "select aggregator, variant_id, count(*) filter (where is_correct) as correct, count(*) as total, "
    "round(count(*) filter (where is_correct) / count(*), 6) as accuracy from a group by 1, 2",
)
def v20(spark, sf):
    return rounded(pk.aggregation_summary(results(spark, sf)))


@query(
    "v21_regrade_pending",
    WITH_R + "select event_id, case when event_id % 17 = 0 then case when final_answer = '' then null else is_correct end "
    "when event_id % 5 = 0 then not is_correct else is_correct end as is_correct from r",
)
def v21(spark, sf):
    return pk.regrade_pending(results(spark, sf)).select("event_id", "is_correct")


@query(
    "v22_end_to_end_accuracy",
    RESULTS + "select aggregator, cast(count(*) filter (where is_correct) as bigint) as correct, "
    "count(distinct problem_id) as total, round(count(*) filter (where is_correct) / count(distinct problem_id), 6) as accuracy "
    "from a group by 1",
)
def v22(spark, sf):
    return rounded(pk.end_to_end_accuracy(results(spark, sf), ["aggregator"]))


# The same metrics over the responses that gave an answer, whose positions have gaps. The twin counts
# the rows before: DuckDB loses the ``- 1`` of ``row_number() - 1`` under a filter ``< 16``.
WITH_ANSWERED = (
    f"with whole as ({fx.RESPONSES_SQL}), r as (select * exclude (response_idx), count(*) over (partition by problem_id "
    "order by response_idx rows between unbounded preceding and 1 preceding) as response_idx from whole where final_answer <> '') "
)
ON_ANSWERED = {
    "v4_set_majority_vote": lambda df: v.set_votes(df, [2, 4, 8]).drop("method"),
    "v5_set_weighted_vote": lambda df: v.set_votes(df, [2, 4, 8], SET_VOTE_SCORES),
    "v6_set_vote_fixed16": lambda df: v.set_votes_fixed16(df, SET_VOTE_SCORES).drop("ground_truth"),
    "v7_pass_at_k": pk.pass_at_k,
    "v8_pass_at_k_fixed": pk.pass_at_k_fixed,
    "v11_evaluate_metrics": lambda df: pk.evaluate_metrics(df, SET_VOTE_SCORES),
    "v18_group_advantages": lambda df: pk.group_advantages(df, 5).select("event_id", "advantage"),
    "v19_group_statistics": lambda df: pk.group_statistics(df, 8),
}


def answered(spark, sf):
    return rewarded(spark, sf).where("final_answer <> ''")


for base, on_rows in ON_ANSWERED.items():
    query(f"{base}_answered", ORACLES[base].replace(WITH_R, WITH_ANSWERED))(
        lambda spark, sf, on_rows=on_rows: rounded(on_rows(answered(spark, sf)))
    )
