"""Confidence scores and log-probability checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import WITH_T, query, rounded
from voteframe.functions import confidence as cf, logprobs as lp
from voteframe.operators import scoring as sc, selection as sel
from voteframe.schemas import SCORE_NAMES

GROUP = 10
NAN = "'nan'::double"

# Token confidences, sliding groups of ten and their order statistics, per response.
SCORED = (
    WITH_T + f", tc as (select *, list_transform(logprobs, lambda t: case when len(t) = 0 then {NAN} "
    "else -list_sum(t) / len(t) end) as c from t), "
    f"gr as (select *, coalesce(len(c), 0) as n, case when coalesce(len(c), 0) = 0 then cast([] as double[]) "
    f"when len(c) < {GROUP} then list_transform(range(0, {GROUP} - len(c) + 1), lambda i: list_sum(c) / {GROUP}) "
    f"else list_transform(range(1, len(c) - {GROUP} + 2), lambda i: list_sum(c[i:i + {GROUP} - 1]) / {GROUP}) end as g from tc), "
    "og as (select *, list_sort(g) as s, len(g) as m, cast(greatest(1, ceil(len(g) * 0.1e0)) as bigint) as k from gr), "
    "scores as (select response_no, response_id, problem_id, n, m, c, g, logprobs, "
    "list_sum(g) / m as mean_group_confidence, list_sum(s[1:k]) / k as bottom_10_percent_confidence, "
    f"list_sum(c[greatest(1, n - {GROUP} + 1):n]) / least(n, {GROUP}) as tail_confidence, "
    f"list_sum(c[1:least(n, {GROUP})]) / least(n, {GROUP}) as head_confidence, "
    # A NaN anywhere makes the smallest group NaN as well.
    f"case when isnan(s[m]) then {NAN} else s[1] end as lowest_group_confidence, "
    "list_sum(s[m - k + 1:m]) / k as top_10_percent_confidence, s[m] as highest_group_confidence from og) "
)


def shown(name: str, empty: str) -> str:
    """A score as value and NaN flag; ``empty`` is the value without log-probabilities."""
    return (
        f"case when n = 0 then {empty} when isnan({name}) then null else round({name}, 6) end as {name}, "
        f"case when n = 0 then {'true' if empty == 'null' else 'false'} else isnan({name}) end as {name}_nan"
    )


def split_nan(df, names):
    """Doubles as rounded value (null for NaN) plus a NaN flag."""
    others = [c for c in df.columns if c not in names]
    cols = []
    for n in names:
        value = F.when(~F.isnan(n), F.round(n, 6))
        cols += [value.alias(n), F.coalesce(F.isnan(n), F.lit(False)).alias(f"{n}_nan")]
    return df.select(*others, *cols)


def scored_sql(extra: str, empty_edges: str, empty_others: str) -> str:
    parts = [
        shown(n, empty_edges if n in ("tail_confidence", "head_confidence") else empty_others)
        for n in SCORE_NAMES
    ]
    return SCORED + f"select response_id, {extra}" + ", ".join(parts) + " from scores"


def with_tokens(spark, sf):
    df = fx.tokens(spark, sf)
    return df.withColumn("c", lp.token_confidence(F.col("logprobs")))


@query(
    "c1_token_confidence",
    SCORED + "select response_id, cast(pos as int) as pos, case when isnan(v) then null else round(v, 6) end as confidence, "
    "isnan(v) as confidence_nan from (select response_id, unnest(range(0, len(c))) as pos, unnest(c) as v from tc)",
)
def c1(spark, sf):
    return split_nan(sc.token_rows(with_tokens(spark, sf), "response_id", "c"), ["confidence"])


@query(
    "c2_group_confidence",
    SCORED + "select response_id, cast(pos as int) as pos, case when isnan(v) then null else round(v, 6) end as confidence, "
    "isnan(v) as confidence_nan from (select response_id, unnest(range(0, len(g))) as pos, unnest(g) as v from gr)",
)
def c2(spark, sf):
    df = fx.tokens(spark, sf).withColumn("g", cf.group_confidence(F.col("logprobs"), GROUP))
    return split_nan(sc.token_rows(df, "response_id", "g"), ["confidence"])


def one_score(name: str, *names: str):
    wanted = names or (name,)

    def run(spark, sf):
        scored = sc.score_responses(fx.tokens(spark, sf), GROUP)
        return split_nan(scored.select("response_id", *wanted), wanted)

    return run


def one_score_sql(*names: str) -> str:
    edges = ("tail_confidence", "head_confidence")
    parts = [shown(n, "null" if n in edges else "0e0") for n in names]
    return SCORED + "select response_id, " + ", ".join(parts) + " from scores"


for _name, _scores in {
    "c3_mean_group_confidence": ("mean_group_confidence",),
    "c4_bottom_10_percent_confidence": ("bottom_10_percent_confidence",),
    "c5_top_10_percent_confidence": ("top_10_percent_confidence",),
    "c6_extreme_group_confidence": ("lowest_group_confidence", "highest_group_confidence"),
    "c7_tail_head_confidence": ("tail_confidence", "head_confidence"),
}.items():
    query(_name, one_score_sql(*_scores))(one_score(_name, *_scores))


@query("c8_all_confidence", scored_sql("", "null", "0e0"))
def c8(spark, sf):
    scored = sc.score_responses(fx.tokens(spark, sf), GROUP)
    return split_nan(scored.select("response_id", *SCORE_NAMES), SCORE_NAMES)


@query("c9_recalculate_confidence", scored_sql("n > 0 as has_scores, ", "null", "null"))
def c9(spark, sf):
    scored = sc.recalculate_confidence(fx.tokens(spark, sf), GROUP)
    return split_nan(scored.select("response_id", "has_scores", *SCORE_NAMES), SCORE_NAMES)


@query(
    "c9_recalculation_report",
    WITH_T + "select count(*) as total, count(*) filter (where len(logprobs) > 0) as valid, "
    "count(*) filter (where coalesce(len(logprobs), 0) = 0) as invalid from t",
)
def c9_report(spark, sf):
    return sc.recalculation_report(sc.recalculate_confidence(fx.tokens(spark, sf), GROUP))


TUMBLING = (
    WITH_T + ", tc as (select response_id, response_no, list_transform(list_filter(coalesce(logprobs, []), lambda t: len(t) > 0), "
    "lambda t: -list_sum(t) / len(t)) as c from t), "
    "gr as (select *, len(c) as n, list_transform(range(0, cast(ceil(len(c) / 4e0) as bigint)), lambda i: "
    "list_sum(c[i * 4 + 1:i * 4 + 4]) / len(c[i * 4 + 1:i * 4 + 4])) as g from tc), "
    "og as (select *, list_sort(g) as s, len(g) as m, cast(greatest(1, floor(len(g) * 0.1e0)) as bigint) as k from gr) "
)


@query(
    "c10_tumbling_confidence",
    TUMBLING + "select response_id, case when n = 0 then 0e0 else round(list_sum(g) / m, 6) end as mean_group_confidence, "
    "case when n = 0 then 0e0 else round(list_sum(s[1:k]) / k, 6) end as bottom_10_percent_confidence, "
    "case when n = 0 then 0e0 else round(list_sum(c[greatest(1, n - 3):n]) / least(n, 4), 6) end as tail_confidence, "
    "case when n = 0 then 0e0 else round(s[1], 6) end as lowest_group_confidence, "
    "case when n = 0 then 0e0 else round(list_sum(s[m - k + 1:m]) / k, 6) end as top_10_percent_confidence, "
    "case when n = 0 then 0e0 else round(s[m], 6) end as highest_group_confidence from og",
)
def c10(spark, sf):
    df = fx.tokens(spark, sf)
    filled = F.filter("logprobs", lambda t: F.size(t) > 0)
    scores = cf.tumbling_confidence(filled, 4)
    return rounded(df.withColumn("s", scores).select("response_id", "s.*"))


@query(
    "c11_normalize_logprobs",
    "select vec_id, cast(pos as int) as pos, 1 as width, round(x, 4) as flat, round(x, 4) as parsed from "
    "(select vec_id, unnest(range(0, len(embedding))) as pos, cast(unnest(embedding) as double) as x from embeddings)",
)
def c11(spark, sf):
    df = fx.table(spark, sf, "embeddings")
    flat = lp.normalize_flat(F.col("embedding"))
    text = F.to_json(flat)
    both = df.select("vec_id", flat.alias("flat"), lp.normalize_json(text).alias("parsed"))
    rows = both.select("vec_id", "parsed", F.posexplode("flat").alias("pos", "token"))
    return rows.select(
        "vec_id", "pos", F.size("token").alias("width"),
        F.round(F.col("token")[0].cast("double"), 4).alias("flat"),
        F.round(F.col("parsed")[F.col("pos")][0].cast("double"), 4).alias("parsed"),
    )


QUALITY = (
    WITH_T + ", u as (select response_id, problem_id, coalesce(len(logprobs), 0) as num_tokens, "
    "coalesce(len(list_filter(logprobs, lambda x: len(x) = 5)), 0) as ok from t), "
    "w as (select *, num_tokens = ok as no_bad, num_tokens = ok and num_tokens > 0 as valid from u), "
    "p as (select problem_id, count(*) as total, count(*) filter (where no_bad) as valid, "
    "round(count(*) filter (where no_bad) / count(*), 6) as valid_ratio from w group by 1) "
)


@query(
    "c12_logprob_quality",
    QUALITY + "select response_id, cast(num_tokens as int) as num_tokens, cast(ok as int) as num_tokens_ok, "
    "no_bad as no_bad_token, valid as is_valid from w",
)
def c12(spark, sf):
    return sc.logprob_quality(fx.tokens(spark, sf)).drop("logprobs", "problem_id", "response_no")


@query(
    "c12_logprob_quality_totals",
    QUALITY + "select count(*) as total, count(*) filter (where valid) as valid, count(*) filter (where not valid) as invalid, "
    "count(*) filter (where not no_bad and num_tokens > 0) as wrong_size from w",
)
def c12_totals(spark, sf):
    return sc.logprob_quality_totals(sc.logprob_quality(fx.tokens(spark, sf)))


@query(
    "c12_logprob_quality_by_problem",
    QUALITY + "select *, case when valid = total then 'all' when valid = 0 then 'none' else 'partial' end as status from p",
)
def c12_problem(spark, sf):
    return rounded(sc.logprob_quality_by_problem(sc.logprob_quality(fx.tokens(spark, sf))))


@query(
    "c12_worst_problems",
    QUALITY + "select *, case when valid = total then 'all' when valid = 0 then 'none' else 'partial' end as status from p "
    "order by valid / total, problem_id limit 10",
)
def c12_worst(spark, sf):
    by_problem = sc.logprob_quality_by_problem(sc.logprob_quality(fx.tokens(spark, sf)))
    return rounded(sc.worst_problems(by_problem))


@query(
    "p9_ensure_confidence_columns",
    SCORED + "select response_id, 1.5e0 as mean_group_confidence, "
    + ", ".join(shown(n, "0e0") for n in SCORE_NAMES if n != "mean_group_confidence") + " from scores",
)
def p9(spark, sf):
    given = fx.tokens(spark, sf).withColumn("mean_group_confidence", F.lit(1.5))
    scored = sel.ensure_confidence_columns(given, GROUP)
    rest = [n for n in SCORE_NAMES if n != "mean_group_confidence"]
    return split_nan(scored.select("response_id", "mean_group_confidence", *rest), rest)


@query(
    "p6_topk_logprobs",
    "select vec_id, cast(pos as int) as pos, round(a, 6) as first_of_records, round(b, 6) as second_of_records, "
    "round(a, 6) as first_of_map from (select vec_id, unnest(range(0, len(embedding))) as pos, "
    "cast(unnest(embedding) as double) as a, cast(unnest(embedding) as double) - 1 as b from embeddings)",
)
def p6(spark, sf):
    df = fx.table(spark, sf, "embeddings").withColumn("x", F.transform("embedding", lambda e: e.cast("double")))
    record = lambda value, token: F.struct(F.lit(token).alias("token"), value.alias("logprob"))
    records = F.transform("x", lambda x: F.array(record(x, "a"), record(x - 1, "b"), record(x - 2, "c")))
    maps = F.transform("x", lambda x: F.create_map(F.lit("a"), x, F.lit("b"), x - 1))
    both = df.select(
        "vec_id", F.posexplode(lp.topk_from_records(records, 2)).alias("pos", "top"),
        lp.topk_from_maps(maps, 1).alias("maps"),
    )
    return both.select(
        "vec_id", "pos", F.round(F.col("top")[0], 6).alias("first_of_records"),
        F.round(F.col("top")[1], 6).alias("second_of_records"),
        F.round(F.col("maps")[F.col("pos")][0], 6).alias("first_of_map"),
    )
