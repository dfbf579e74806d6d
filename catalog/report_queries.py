"""Distributions, correlations and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import WITH_Q, WITH_R, query, rounded
from voteframe.operators import (
    correlation as co, distributions as di, overlap, selection as sel, within_problem as wp,
)
from voteframe.schemas import REPORT_SCORES
from voteframe.session import cut_lineage

TOKENS = "output_token_count"
SCORE = "tail_confidence"


def pct(value: str, source: str, *fractions: float) -> str:
    """Linear percentiles as a list."""
    return f"(select quantile_cont({value}::double, [{', '.join(map(str, fractions))}]) from {source})"


@query(
    "a1_pearson",
    WITH_Q + "select count(*) as n, round(corr(score, cast(is_correct as int)), 6) as r from q",
)
def a1(spark, sf):
    return rounded(co.pearson(fx.quality(spark, sf), "score", "is_correct"))


@query(
    "a1_pearson_by_dataset",
    WITH_R + "select dataset, model, count(tail_confidence) as n, round(corr(tail_confidence, cast(is_correct as int)), 6) as r "
    "from r group by 1, 2",
)
def a1_by(spark, sf):
    return rounded(co.pearson(fx.responses(spark, sf), SCORE, "is_correct", ["dataset", "model"]))


def p_sql(r: str, n: str) -> str:
    """The p-value of r over n pairs by the finite series of Student's t, terms from the gamma function."""
    v, s, c2 = f"({n} - 2)", f"least(abs({r}), 1)", f"greatest(1 - {r} * {r}, 0)"
    even = f"{s} * coalesce(list_sum(list_transform(range({v} // 2), lambda k: exp(lgamma(k + 0.5e0) - lgamma(0.5e0) - lgamma(k + 1)) * pow({c2}, k))), 0)"
    odd = (
        f"2 / pi() * (asin({s}) + {s} * sqrt({c2}) * coalesce(list_sum(list_transform(range({v} // 2), "
        f"lambda k: exp(lgamma(k + 1) + lgamma(1.5e0) - lgamma(k + 1.5e0)) * pow({c2}, k))), 0))"
    )
    return f"case when {r} is not null and {n} > 2 then 1 - case when {n} % 2 = 0 then {even} else {odd} end end"


@query(
    "a1_pearson_p_value",
    WITH_Q + ", p as (select count(*) as n, corr(score, cast(is_correct as int)) as r from q) "
    f"select n, round(r, 6) as r, round({p_sql('r', 'n')}, 6) as p_value from p",
)
def a1_p(spark, sf):
    return rounded(co.pearson(fx.quality(spark, sf), "score", "is_correct", with_p=True))


RANKED = (
    ", base as (select {x} as x, {y} as y from {src} where {x} is not null and {y} is not null), "
    "ranks as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2e0 as rx, "
    "rank() over (order by y) + (count(*) over (partition by y) - 1) / 2e0 as ry from base) "
)


@query(
    "a2_spearman",
    WITH_Q + RANKED.format(x="score", y="cast(is_correct as int)", src="q") + "select count(*) as n, round(corr(rx, ry), 6) as rho from ranks",
)
def a2(spark, sf):
    return rounded(co.spearman(fx.quality(spark, sf), "score", "is_correct"))


@query(
    "a2_spearman_tokens",
    WITH_R + RANKED.format(x="tail_confidence", y=TOKENS, src="r") + "select count(*) as n, round(corr(rx, ry), 6) as rho from ranks",
)
def a2_tokens(spark, sf):
    return rounded(co.spearman(fx.responses(spark, sf), SCORE, TOKENS))


def _matrix_sql() -> str:
    pairs = [(TOKENS, "accuracy")] + [(s, "accuracy") for s in REPORT_SCORES] + [(s, "tokens") for s in REPORT_SCORES]
    targets = {"accuracy": "cast(is_correct as int)", "tokens": TOKENS}
    long = " union all ".join(
        f"select '{x}' as x, '{y}' as y, {x}::double as vx, {targets[y]}::double as vy from kept where {x} is not null" for x, y in pairs
    )
    return (
        ", kept as (select * from r where output_token_count < 4900 * 0.99e0), long as (" + long + "), "
        "ranks as (select *, rank() over (partition by x, y order by vx) + (count(*) over (partition by x, y, vx) - 1) / 2e0 as rx, "
        "rank() over (partition by x, y order by vy) + (count(*) over (partition by x, y, vy) - 1) / 2e0 as ry from long) "
        "select x, y, count(*) as n, round(corr(vx, vy), 6) as pearson, round(corr(rx, ry), 6) as spearman from ranks group by 1, 2"
    )


@query("a3_correlation_matrix", WITH_R + _matrix_sql())
def a3(spark, sf):
    flagged = di.flag_truncated(fx.responses(spark, sf), 4900, TOKENS)
    return rounded(co.correlation_matrix(flagged.where(~F.col("truncated")), REPORT_SCORES, TOKENS, "is_correct"))


def bins_sql(value: str, source: str, fractions: tuple, closed: bool, keep_empty: bool = False) -> str:
    n = len(fractions) - 1
    top = f" or (b.bin = {n - 1} and v = high)" if closed else ""
    join = "left join" if keep_empty else "join"
    return (
        f"select b.bin, round(low, 6) as low, round(high, 6) as high, count(v) as count, "
        f"round(coalesce(avg(cast(ok as int)), 0), 6) as accuracy from "
        f"(select cast(i as int) as bin, e[i + 1] as low, e[i + 2] as high from (select {pct('v', source, *fractions)} as e), "
        f"(select unnest(range(0, {n})) as i)) b {join} {source} on (v >= low and (v < high{top})) group by 1, 2, 3"
    )


QV = WITH_Q + ", v as (select score as v, is_correct as ok from q where score is not null) "
RV = WITH_R + f", v as (select {SCORE} as v, is_correct as ok from r where {SCORE} is not null) "


@query("a4_accuracy_by_percentile", QV + bins_sql("score", "v", di.ACCURACY_PERCENTILES, False))
def a4(spark, sf):
    return rounded(di.accuracy_by_percentile(fx.quality(spark, sf), "score", "is_correct", di.ACCURACY_PERCENTILES, False))


@query("a5_accuracy_by_percentile_closed", QV + bins_sql("score", "v", di.CLOSED_PERCENTILES, True))
def a5(spark, sf):
    return rounded(di.accuracy_by_percentile(fx.quality(spark, sf), "score", "is_correct", di.CLOSED_PERCENTILES, True))


def _all_scores_sql() -> str:
    values = ", ".join(
        f"v{i} as (select {s} as v, is_correct as ok from r where {s} is not null)" for i, s in enumerate(REPORT_SCORES)
    )
    parts = [f"select '{s}' as metric, z.* from ({bins_sql(s, f'v{i}', di.CLOSED_PERCENTILES, True)}) z" for i, s in enumerate(REPORT_SCORES)]
    return WITH_R + f", {values} " + " union all ".join(parts)


@query("a5_accuracy_by_percentile_all_scores", _all_scores_sql())
def a5_scores(spark, sf):
    long = fx.responses(spark, sf).select(
        "is_correct", F.inline(F.array(*[F.struct(F.lit(s).alias("metric"), F.col(s).alias("value")) for s in REPORT_SCORES]))
    )
    return rounded(di.accuracy_by_percentile(long, "value", "is_correct", di.CLOSED_PERCENTILES, True, keys=["metric"]))


@query(
    "a6_confidence_correlation",
    RV + "select z.*, round((select corr(v, cast(ok as int)) from v), 6) as pearson from (" + bins_sql(SCORE, "v", di.QUARTILES, False, True) + ") z",
)
def a6(spark, sf):
    return rounded(co.confidence_correlation(fx.responses(spark, sf), SCORE, "is_correct"))


@query(
    "a7_confidence_by_correctness",
    RV + "select count(*) as n, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(avg(cast(ok as int)), 6) as accuracy, "
    "round(avg(v) filter (where ok), 6) as mean_correct, round(avg(v) filter (where not ok), 6) as mean_wrong from v",
)
def a7(spark, sf):
    return rounded(di.confidence_by_correctness(fx.responses(spark, sf), SCORE, "is_correct"))


@query(
    "a8_confidence_histogram",
    QV + ", s as (select min(v) as lo, max(v) as hi from v), h as (select ok as is_correct, "
    "cast(least(floor((v - lo) / (hi - lo) * 99), 98) as int) as bin, count(*) as count from v, s group by 1, 2) "
    "select *, round(count / sum(count) over (partition by is_correct), 6) as share from h",
)
def a8(spark, sf):
    return rounded(di.confidence_histogram(fx.quality(spark, sf), "score", "is_correct"))


def quantile_bins_sql(where: str, value: str, ok: str, scores: tuple[str, ...], source: str, bins: int = 10) -> str:
    fractions = [i / bins for i in range(bins + 1)]
    means = "".join(f", round(avg({s}), 6) as {s}" for s in scores)
    return (
        f", v as (select {value}::double as v, {ok} as ok{''.join(', ' + s for s in scores)} from {source} where {where}), "
        f"e as (select list_sort(list_distinct({pct('v', 'v', *fractions)})) as e), "
        "b as (select cast(i as int) as bin, e[i + 1] as low, e[i + 2] as high, len(e) - 2 as top from e, (select unnest(range(0, 10)) as i) where i < len(e) - 1) "
        f"select bin, count(*) as count, round(avg(cast(ok as int)), 6) as accuracy{means}, "
        "concat(cast(cast(floor(low) as bigint) as string), '-', cast(cast(floor(high) as bigint) as string)) as label "
        "from b join v on (v >= low and (v < high or (bin = top and v <= high))) group by bin, low, high"
    )


@query(
    "a9_accuracy_by_quantile_bins",
    WITH_R + quantile_bins_sql("not missing", "coalesce(output_token_count, 0) + coalesce(prompt_token_count, 0)", "is_correct", REPORT_SCORES, "r"),
)
def a9(spark, sf):
    df = fx.responses(spark, sf)
    df = df.withColumn("total", sel.total_tokens(df))
    return rounded(di.accuracy_by_quantile_bins(df, "total", "is_correct", REPORT_SCORES))


@query("a10_accuracy_by_content_length", WITH_Q + quantile_bins_sql("words is not null", "words", "is_correct", (), "q"))
def a10(spark, sf):
    return rounded(di.accuracy_by_quantile_bins(fx.quality(spark, sf), "words", "is_correct"))


def stats_sql(value: str, fractions: tuple, std: str = "stddev_pop") -> str:
    cols = [f"round(quantile_cont({value}::double, 0.5), 6) as median", f"round(avg({value}), 6) as mean", f"round({std}({value}), 6) as std"]
    cols += [f"round(quantile_cont({value}::double, {f}), 6) as p{round(f * 100)}" for f in fractions]
    return ", ".join(cols)


@query(
    "a11_token_distribution",
    WITH_R + f"select count({TOKENS}) as n, min({TOKENS}) as min, max({TOKENS}) as max, " + stats_sql(TOKENS, di.TAIL_PERCENTILES, "stddev_samp") + " from r",
)
def a11(spark, sf):
    return rounded(di.token_distribution(fx.responses(spark, sf)))


@query(
    "a11_token_bins",
    "select cast(least(n_chars // 5000, 7) as int) as bin, count(*) as count, cast(least(n_chars // 5000, 7) * 5000 as int) as low from documents group by 1, 3",
)
def a11_bins(spark, sf):
    return di.token_bins(fx.table(spark, sf, "documents"), "n_chars")


LENGTHS = "select turn, role, len(text) as chars from conversations"
POST = (
    WITH_R + ", w as (select case when text_kind in (0, 2, 3, 4) then cast(floor(len(list_filter(string_split(expected_strict, ' '), "
    "lambda w: w <> '')) * 1.3e0) as int) else 0 end as t from r) "
)


@query(
    "a12_adaptive_statistics",
    POST + "select count(*) as total, round(avg(t), 6) as mean_all, count(*) filter (where t > 0) as positive, "
    "min(t) filter (where t > 0) as min, max(t) as max, "
    + stats_sql("case when t > 0 then t end", di.TAIL_PERCENTILES) + " from w",
)
def a12(spark, sf):
    from voteframe.functions.text import post_marker_tokens

    df = fx.responses(spark, sf).select(post_marker_tokens(F.col("generated_text")).alias("t"))
    # Counting tokens reads whole texts; the counts are kept and the texts are read once.
    return rounded(di.positive_statistics(cut_lineage(df, "tokens"), "t"))


def ladder_sql(source: str, value: str, ladder) -> str:
    lists = ", ".join(f"({limit or 10**9}, [{', '.join(map(str, edges))}])" for limit, edges in ladder)
    return (
        f"select cast(bin as int) as bin, count(*) as count, cast(low as int) as low from (select {value} as v, "
        f"(select e from (values {lists}) l(lim, e) where (select max({value}) from {source}) < lim order by lim limit 1) as e from {source} "
        f"where {value} > 0) x, lateral (select len(list_filter(e, lambda y: y <= v)) - 1 as bin), "
        "lateral (select e[bin + 1] as low) group by 1, 3"
    )


@query("a12_adaptive_bins", "with c as (" + LENGTHS + ") " + ladder_sql("c", "chars", di.CONTENT_LADDER))
def a12_bins(spark, sf):
    df = fx.table(spark, sf, "conversations").select(F.length("text").alias("chars"))
    return di.adaptive_bins(df, "chars")


@query("a12_prompt_bins", "with c as (select len(text) as chars from benchmark) " + ladder_sql("c", "chars", di.PROMPT_LADDER))
def a12_prompt(spark, sf):
    df = fx.table(spark, sf, "benchmark").select(F.length("text").alias("chars"))
    return di.adaptive_bins(df, "chars", di.PROMPT_LADDER)


@query(
    "a13_prompt_token_summary",
    WITH_R + "select case when grouping(split) = 1 then 'all' else split end as dataset, count(*) as samples, "
    "min(prompt_token_count) as min, max(prompt_token_count) as max, " + stats_sql("prompt_token_count", (0.95, 0.99))
    + " from r group by rollup(split)",
)
def a13(spark, sf):
    return rounded(di.prompt_token_summary(fx.responses(spark, sf)))


PER_PROBLEM = (
    WITH_R + ", p as (select problem_id, count(*) as n, avg(cast(is_correct as int)) as accuracy, avg(output_token_count) as value_mean, "
    "stddev_pop(output_token_count) as value_std, case when min(output_token_count) = max(output_token_count) then 0e0 "
    "when min(is_correct) = max(is_correct) then null else corr(output_token_count, cast(is_correct as int)) end as r "
    "from r where output_token_count is not null group by 1 having count(*) >= 2) "
)


def by_problem(spark, sf, with_p=False):
    return co.per_problem_correlation(fx.responses(spark, sf), TOKENS, "is_correct", with_p=with_p)


@query(
    "a14_per_problem_correlation",
    PER_PROBLEM + "select problem_id, n, round(accuracy, 6) as accuracy, round(value_mean, 6) as value_mean, "
    "round(value_std, 6) as value_std, round(r, 6) as r from p",
)
def a14(spark, sf):
    return rounded(by_problem(spark, sf))


WITH_P = PER_PROBLEM + f", w as (select *, case when value_std = 0 then 1e0 else {p_sql('r', 'n')} end as p_value from p) "


@query(
    "a14_per_problem_p_value",
    WITH_P + "select problem_id, n, round(accuracy, 6) as accuracy, round(value_mean, 6) as value_mean, "
    "round(value_std, 6) as value_std, round(r, 6) as r, round(p_value, 6) as p_value from w",
)
def a14_p(spark, sf):
    return rounded(by_problem(spark, sf, True))


@query(
    "a15_correlation_overview",
    PER_PROBLEM + "select count(*) as problems, round(avg(r), 6) as mean, round(stddev_pop(r), 6) as std, round(min(r), 6) as min, "
    "round(max(r), 6) as max, count(*) filter (where r > 0) as positive, count(*) filter (where r < 0) as negative, "
    "count(*) filter (where abs(r) < 0.1) as weak, round(quantile_cont(r, 0.5), 6) as median from p",
)
def a15(spark, sf):
    overview = co.correlation_overview(by_problem(spark, sf, True))
    return rounded(overview.drop("significant", "significant_positive", "significant_negative"))


@query(
    "a15_significance_counts",
    WITH_P + "select count(*) as problems, count(*) filter (where p_value < 0.05) as significant, "
    "count(*) filter (where p_value < 0.05 and r > 0) as significant_positive, "
    "count(*) filter (where p_value < 0.05 and r < 0) as significant_negative from w",
)
def a15_p(spark, sf):
    overview = co.correlation_overview(by_problem(spark, sf, True))
    return overview.select("problems", "significant", "significant_positive", "significant_negative")


@query(
    "a15_representative_problems",
    PER_PROBLEM + "select kind, problem_id, round(r, 6) as r from ("
    "(select 'positive' as kind, problem_id, r from p where r > 0.3 order by r desc, problem_id limit 5) union all "
    "(select 'negative', problem_id, r from p where r < -0.3 order by r, problem_id limit 5) union all "
    "(select 'weak', problem_id, r from p where abs(r) < 0.1 order by md5(concat(problem_id, '|42')), problem_id limit 3))",
)
def a15_examples(spark, sf):
    return rounded(co.representative_problems(by_problem(spark, sf)).select("kind", "problem_id", "r"))


@query(
    "a16_per_problem_bins",
    WITH_R + ", s as (select problem_id, min(output_token_count)::double as lo, max(output_token_count)::double as hi from r where not missing "
    "group by 1 having count(*) >= 2), b as (select r.*, lo, hi, cast(case when hi = lo then 0 else "
    "least(floor((output_token_count - lo) / ((hi - lo) / 10)), 9) end as int) as bin from r join s using (problem_id) where not missing) "
    "select problem_id, bin, round(case when hi = lo then lo else lo + (hi - lo) / 10 * (bin + 0.5e0) end, 6) as midpoint, count(*) as count, "
    "round(avg(cast(is_correct as int)), 6) as accuracy, round(avg(tail_confidence), 6) as tail_confidence from b group by problem_id, bin, lo, hi",
)
def a16(spark, sf):
    return rounded(wp.per_problem_bins(fx.responses(spark, sf), TOKENS, "is_correct", [SCORE]))


DELTAS = (
    WITH_R + ", d as (select *, tail_confidence - avg(tail_confidence) over w as score_delta, output_token_count - avg(output_token_count) over w "
    "as token_delta, count(*) over w as cnt from r where tail_confidence is not null window w as (partition by problem_id)), "
    "k as (select event_id, is_correct as ok, score_delta, token_delta from d where cnt >= 2) "
)


def deltas(spark, sf):
    """Deltas rounded, so that both engines rank and bin the same numbers."""
    rows = wp.within_problem_deltas(fx.responses(spark, sf), SCORE, "is_correct")
    return rows.withColumns({c: F.round(c, 4) for c in ("score_delta", "token_delta")})


@query(
    "a17_within_problem_deltas",
    DELTAS + "select event_id, round(score_delta, 4) as score_delta, round(token_delta, 4) as token_delta from k",
)
def a17(spark, sf):
    return deltas(spark, sf).select("event_id", "score_delta", "token_delta")


@query(
    "a17_delta_correlations",
    DELTAS + ", g as (select round(score_delta, 4) as s, round(token_delta, 4) as t, cast(ok as int)::double as c from k), "
    "long as (select 'score_delta_vs_correct' as pair, s as x, c as y from g union all select 'token_delta_vs_correct', t, c from g "
    "union all select 'score_delta_vs_token_delta', s, t from g), ranks as (select *, "
    "rank() over (partition by pair order by x) + (count(*) over (partition by pair, x) - 1) / 2e0 as rx, "
    "rank() over (partition by pair order by y) + (count(*) over (partition by pair, y) - 1) / 2e0 as ry from long) "
    "select pair, count(*) as n, round(corr(x, y), 6) as r, round(corr(rx, ry), 6) as rho from ranks group by 1",
)
def a17_corr(spark, sf):
    return rounded(wp.delta_correlations(deltas(spark, sf), "is_correct"))


@query(
    "a17_delta_quartile_accuracy",
    DELTAS + ", v as (select round(score_delta, 4) as v, ok from k) " + bins_sql("v", "v", di.QUARTILES, True),
)
def a17_bins(spark, sf):
    return rounded(wp.delta_quartile_accuracy(deltas(spark, sf), "score_delta", "is_correct"))


@query(
    "a18_within_problem_median_split",
    WITH_R + ", k as (select problem_id, tail_confidence as v, is_correct as ok from r where tail_confidence is not null "
    "qualify count(*) over (partition by problem_id) >= 2), m as (select problem_id, quantile_cont(v, 0.5) as md from k group by 1), "
    "p as (select problem_id, avg(cast(ok as int)) filter (where v >= md) as hi, avg(cast(ok as int)) filter (where v < md) as lo "
    "from k join m using (problem_id) group by 1) select round(avg(hi), 6) as high_accuracy, count(hi) as high_problems, "
    "round(avg(lo), 6) as low_accuracy, count(lo) as low_problems from p",
)
def a18(spark, sf):
    return rounded(wp.within_problem_median_split(fx.responses(spark, sf), SCORE, "is_correct"))


@query(
    "a19_within_problem_deciles",
    WITH_R + ", k as (select problem_id, is_correct as ok, row_number() over (partition by problem_id order by output_token_count, response_idx) - 1 as pos, "
    "count(*) over (partition by problem_id) as n from r where output_token_count is not null), "
    "s as (select cast(p as int) as slice, cast(case when p = 0 then 0 when p = 100 then floor(n * 0.9e0) else floor(n * (p / 100)) end as bigint) as lo, "
    "cast(case when p = 0 then greatest(1, floor(n * 0.1e0)) when p = 100 then n else floor(n * ((p + 10) / 100)) end as bigint) as hi, k.* "
    "from k, (select unnest(range(0, 101, 10)) as p) where n >= 2), "
    "a as (select problem_id, slice, avg(cast(ok as int)) as acc from s where pos >= lo and pos < hi group by 1, 2) "
    "select slice, round(avg(acc), 6) as accuracy, count(*) as problems from a group by 1",
)
def a19(spark, sf):
    return rounded(wp.within_problem_deciles(fx.responses(spark, sf), TOKENS, "is_correct"))


PROFILE = (
    WITH_R + ", tt as (select *, output_token_count + prompt_token_count as total from r), "
    "profile as (select problem_id, count(*) as responses, count(*) filter (where total = (select max(total) from tt)) as at_max, "
    "count(*) filter (where text_kind not in (0, 2, 3, 4)) as no_marker, avg(cast(is_correct as int)) * 100 as accuracy_pct, "
    "cast(max(len(problem_text)) as int) as prompt_length, avg(output_token_count) as mean_output_tokens from tt group by 1) "
)


def profile(spark, sf):
    df = fx.responses(spark, sf)
    return di.problem_profile(df, sel.total_tokens(df, False))


@query(
    "a20_problem_profile",
    PROFILE + "select problem_id, responses, at_max, no_marker, round(accuracy_pct, 6) as accuracy_pct, prompt_length, "
    "round(mean_output_tokens, 6) as mean_output_tokens from profile",
)
def a20(spark, sf):
    return rounded(profile(spark, sf))


@query(
    "a21_problem_profile_summary",
    PROFILE + ", long as (" + " union all ".join(f"select '{m}' as measure, {m}::double as v from profile" for m in di.PROFILE_MEASURES)
    + ") select measure, count(*) as n, round(min(v), 6) as min, round(max(v), 6) as max, " + stats_sql("v", di.PROFILE_PERCENTILES)
    + " from long group by 1",
)
def a21(spark, sf):
    return rounded(di.problem_profile_summary(profile(spark, sf)))


@query(
    "a21_count_histogram",
    PROFILE + "select no_marker as value, count(*) as problems, round(avg(prompt_length), 6) as mean_prompt_length, "
    "round(count(*) * 100e0 / (select count(*) from profile), 6) as pct from profile group by 1",
)
def a21_histogram(spark, sf):
    return rounded(di.profile_count_histogram(profile(spark, sf), "no_marker"))


@query(
    "a21_accuracy_bins",
    PROFILE + "select cast(least(floor(accuracy_pct / 20), 4) as int) as bin, count(*) as count from profile group by 1",
)
def a21_accuracy(spark, sf):
    return di.profile_accuracy_bins(profile(spark, sf))


@query(
    "a21_token_bins",
    PROFILE + "select cast(least(floor(mean_output_tokens / 1000), 4) as int) as bin, count(*) as count, "
    "cast(least(floor(mean_output_tokens / 1000), 4) * 1000 as int) as low from profile group by 1, 3",
)
def a21_tokens(spark, sf):
    return di.profile_token_bins(profile(spark, sf))


FLAGGED = (
    WITH_R + ", f as (select problem_id, output_token_count >= 4900 * 0.99e0 as truncated, is_correct, cast(2 + event_id % 40 as int) as content_token_count from r) "
)


def flagged(spark, sf):
    df = fx.responses(spark, sf).withColumn("content_token_count", F.expr("cast(2 + event_id % 40 as int)"))
    return di.flag_truncated(df, 4900, TOKENS)


@query(
    "a22_truncation_report",
    FLAGGED + "select problem_id, count(*) filter (where truncated) as truncated, count(*) as total, count(*) filter (where is_correct) as correct, "
    "round(avg(content_token_count), 6) as mean_content_tokens, round(count(*) filter (where is_correct) / count(*), 6) as accuracy from f group by 1",
)
def a22(spark, sf):
    return rounded(di.truncation_report(flagged(spark, sf)))


@query(
    "a22_truncation_totals",
    FLAGGED + "select count(distinct problem_id) as problems, count(distinct case when truncated then problem_id end) as problems_with_truncated, "
    "count(*) as responses, count(*) filter (where truncated) as excluded, count(*) filter (where not truncated) as kept from f",
)
def a22_totals(spark, sf):
    return di.truncation_totals(di.truncation_report(flagged(spark, sf)))


def _part_sql(part: str, where: str, percentiles: bool) -> str:
    p = [f"round(quantile_cont(content_token_count::double, {f}), 6)" if percentiles else "null::double" for f in di.PROFILE_PERCENTILES]
    named = ", ".join(f"{v} as p{round(f * 100)}" for v, f in zip(p, di.PROFILE_PERCENTILES))
    return (
        f"select '{part}' as part, " + stats_sql("content_token_count", ()) + ", min(content_token_count) as min, max(content_token_count) as max, "
        f"{named}, round(avg(cast(is_correct as int)), 6) as accuracy, count(*) filter (where is_correct) as correct, count(*) as total from f where {where}"
    )


@query(
    "a23_token_and_accuracy_stats",
    FLAGGED + _part_sql("all", "true", False) + " union all " + _part_sql("kept", "not truncated", True),
)
def a23(spark, sf):
    return rounded(di.token_and_accuracy_stats(flagged(spark, sf)))


LENGTH_CAP = 4000
SOLUTIONS = (
    WITH_R + ", s as (select problem_id, count(*) as total_solutions, count(*) filter (where output_token_count <= 2000) as kept_solutions, "
    "cast(coalesce(sum(output_token_count) filter (where output_token_count <= 2000), 0) as bigint) as sum_tokens, "
    "coalesce(avg(output_token_count) filter (where output_token_count <= 2000), 0) as avg_tokens, "
    "coalesce(max(output_token_count) filter (where output_token_count <= 2000), 0) as max_tokens, "
    "coalesce(min(output_token_count) filter (where output_token_count <= 2000), 0) as min_tokens from r group by 1) "
)


@query(
    "a24_solution_lengths",
    SOLUTIONS + "select problem_id, total_solutions, kept_solutions, sum_tokens, round(avg_tokens, 6) as avg_tokens, max_tokens, min_tokens, "
    "sum_tokens > 2000 as excluded from s",
)
def a24(spark, sf):
    return rounded(di.solution_lengths(fx.responses(spark, sf), 2000, TOKENS))


@query(
    "a24_solution_length_report",
    SOLUTIONS + ", kept as (select output_token_count as t from r where output_token_count <= 2000 and problem_id in (select problem_id from s where sum_tokens <= 2000)) "
    "select (select count(*) from s) as total_problems, (select count(*) from s where sum_tokens <= 2000) as kept_problems, "
    "(select count(*) from s where sum_tokens > 2000) as excluded_problems, count(*) as total_solutions, round(avg(t), 6) as avg_tokens, "
    "max(t) as max_tokens, min(t) as min_tokens, (list_sort(list(t)))[count(*) // 2 + 1] as median_tokens from kept",
)
def a24_report(spark, sf):
    return rounded(di.solution_length_report(fx.responses(spark, sf), 2000, TOKENS))


@query(
    "a25_run_report",
    WITH_R + "select count(*) as responses, count(distinct problem_id) as problems, round(count(*) / count(distinct problem_id), 6) as responses_per_problem, "
    "cast(sum(t) as bigint) as tokens, round(avg(t), 6) as mean_tokens, min(t) as min_tokens, max(t) as max_tokens, "
    "count(*) filter (where t = 4900) as at_limit from (select *, coalesce(output_token_count, 0) as t from r)",
)
def a25(spark, sf):
    return rounded(di.run_report(fx.responses(spark, sf), 4900))


SIDES = WITH_R + ", a as (select * from r where worker_gpu = 'gpu_0'), b as (select * from r where worker_replica <> 'shard_0') "


def sides(spark, sf):
    df = fx.responses(spark, sf).withColumns({"is_correct_exact": F.col("is_correct"), "is_correct_equivalent": F.col("is_correct")})
    return df.where("worker_gpu = 'gpu_0'"), df.where("worker_replica <> 'shard_0'")


@query(
    "a26_key_overlap",
    SIDES + "select (select count(distinct problem_id) from a) as keys_a, (select count(distinct problem_id) from b) as keys_b, "
    "(select count(*) from (select problem_id from a intersect select problem_id from b)) as common, "
    "(select count(*) from (select problem_id from a except select problem_id from b)) as only_a, "
    "(select count(*) from (select problem_id from b except select problem_id from a)) as only_b",
)
def a26(spark, sf):
    return overlap.key_overlap(*sides(spark, sf))


@query(
    "a27_compare_on_common",
    SIDES + ", ca as (select * from a where problem_id in (select problem_id from b)), cb as (select * from b where problem_id in (select problem_id from a)), "
    "m as (select (select count(*) from ca) as rows_a, (select count(*) from cb) as rows_b, (select avg(cast(is_correct as int)) from ca) as x, "
    "(select avg(cast(is_correct as int)) from cb) as y) select 'is_correct_exact' as grader, rows_a, round(x, 6) as accuracy_a, rows_b, "
    "round(y, 6) as accuracy_b, round((y - x) * 100, 6) as difference_pp from m union all "
    "select 'is_correct_equivalent', rows_a, round(x, 6), rows_b, null, null from m",
)
def a27(spark, sf):
    a, b = sides(spark, sf)
    return rounded(overlap.compare_on_common(a, b.drop("is_correct_equivalent")))
