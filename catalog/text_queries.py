"""Text extraction and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import WITH_R, query, rounded
from voteframe.functions import grading as g, text as t
from voteframe.operators import grading as og
from voteframe.session import cut_lineage

def TEXT():
    return F.col("generated_text")


@query("t1_reasoning_content", WITH_R + "select event_id, expected_reasoning as reasoning_content from r")
def t1(spark, sf):
    df = fx.responses(spark, sf)
    return df.select("event_id", F.coalesce(t.reasoning_content(TEXT()), F.lit("")).alias("reasoning_content"))


@query("t2_content_strict", WITH_R + "select event_id, expected_strict as content from r")
def t2(spark, sf):
    return fx.responses(spark, sf).select("event_id", t.content_strict(TEXT()).alias("content"))


@query("t3_content_lenient", WITH_R + "select event_id, expected_lenient as content from r")
def t3(spark, sf):
    return fx.responses(spark, sf).select("event_id", t.content_lenient(TEXT()).alias("content"))


@query(
    "t4_content_for_row",
    WITH_R + "select event_id, case when expected_reasoning <> '' then expected_strict "
    "else generated_text end as by_reasoning, expected_strict as strict, "
    "case when expected_lenient <> '' then expected_lenient else generated_text end as evaluated from r",
)
def t4(spark, sf):
    return fx.responses(spark, sf).select(
        "event_id",
        t.content_for_row(TEXT()).alias("by_reasoning"),
        t.content_for_row(TEXT(), "strict").alias("strict"),
        t.content_for_row(TEXT(), "evaluation").alias("evaluated"),
    )


@query("t5_final_answer", WITH_R + "select event_id, expected_answer as final_answer from r")
def t5(spark, sf):
    return fx.responses(spark, sf).select(
        "event_id",
        F.coalesce(t.final_answer(t.content_for_row(TEXT())), F.lit("")).alias("final_answer"),
    )


# The first box cut at its first closing brace; without a box the number that ends the text.
@query(
    "t6_final_answer_regex",
    WITH_R + "select event_id, case when text_kind = 0 then trim(final_answer) "
    "when text_kind = 1 then case when final_answer = '' then '' else trim(final_answer) end "
    "when text_kind = 2 then 'wrong' "
    f"when text_kind = 3 then concat({fx.FRAC}, cast(response_idx as string)) "
    "when text_kind = 4 then concat('a', chr(92)) when text_kind = 5 then cast(pos as string) "
    "when text_kind = 6 then concat(cast(pos as string), '.5') else '' end as final_answer from r",
)
def t6(spark, sf):
    df = fx.responses(spark, sf)
    # Strict content where there is some, else the raw text, so every construct is exercised.
    content = F.when(t.content_strict(TEXT()) != "", t.content_strict(TEXT())).otherwise(TEXT())
    return df.select(
        "event_id", F.coalesce(t.final_answer_regex(content), F.lit("")).alias("final_answer")
    )


@query(
    "t7_final_answer_fallbacks",
    WITH_R + "select event_id, case when text_kind in (0, 1, 2) and event_id % 2 = 0 then trim(final_answer) "
    "when event_id % 10 = 1 then concat('v', cast(pos as string)) "
    "when event_id % 10 = 3 then concat('t ', cast(pos as string)) "
    "when event_id % 10 = 5 then concat(cast(pos as string), '.25') "
    "when event_id % 10 = 7 then concat('-', cast(pos as string), '.5') "
    "when event_id % 10 = 9 then concat('w', cast(pos as string)) else '' end as final_answer from r",
)
def t7(spark, sf):
    df = fx.responses(spark, sf)
    pos = F.col("pos").cast("string")
    kind = F.col("event_id") % 10
    text = (
        F.when(F.col("text_kind").isin(0, 1, 2) & (F.col("event_id") % 2 == 0), TEXT())
        .when(kind == 1, F.concat(F.lit("So\nFINAL Answer: v"), pos, F.lit(" \nmore 3")))
        .when(kind == 3, F.concat(F.lit("Therefore, t "), pos, F.lit("  ")))
        .when(kind == 5, F.concat(F.lit("x\ny = "), pos, F.lit(".25 ")))
        .when(kind == 7, F.concat(F.lit("first 1\n\nabout -"), pos, F.lit(".5 units\n\n ")))
        .when(kind == 9, F.concat(F.lit("\\boxed{\\text{w"), pos, F.lit("}}")))
        .otherwise(F.lit("nothing here"))
    )
    return df.select("event_id", t.final_answer_fallbacks(text).alias("final_answer"))


@query(
    "t8_token_count",
    "select doc_id, cast(n as int) as words, cast(floor(n * 1.3e0) as int) as scaled from "
    f"(select doc_id, {fx.WORDS_SQL.format('text')} as n from documents)",
)
def t8(spark, sf):
    text = F.col("text")
    return fx.table(spark, sf, "documents").select(
        "doc_id", t.token_count(text).alias("words"), t.token_count(text, "scaled").alias("scaled")
    )


@query(
    "t9_post_marker_tokens",
    WITH_R + "select event_id, case when text_kind in (0, 2, 3, 4) then "
    "cast(floor(len(list_filter(string_split(expected_strict, ' '), lambda w: w <> '')) * 1.3e0) as int) "
    "else 0 end as tokens from r",
)
def t9(spark, sf):
    return fx.responses(spark, sf).select("event_id", t.post_marker_tokens(TEXT()).alias("tokens"))


@query(
    "t10_chat_completion_text",
    "select conv_id, turn, text as completion from conversations",
)
def t10(spark, sf):
    chats = fx.table(spark, sf, "conversations")
    messages = F.array(F.struct("role", F.col("text").alias("content")))
    return chats.select("conv_id", "turn", t.chat_completion_text(messages).alias("completion"))


@query(
    "t11_empty_answer_overlap",
    WITH_R + "select count(*) filter (where final_answer = '') as empty_answers, "
    "count(*) filter (where content = '') as empty_contents, "
    "count(*) filter (where final_answer = '' and content = '') as both_empty, "
    "round(count(*) filter (where final_answer = '' and content = '') * 100e0 / "
    "count(*) filter (where final_answer = ''), 6) as pct_of_empty_answers, "
    "round(count(*) filter (where final_answer = '' and content = '') * 100e0 / "
    "count(*) filter (where content = ''), 6) as pct_of_empty_contents from r",
)
def t11(spark, sf):
    return rounded(og.empty_answer_overlap(fx.responses(spark, sf)))


@query(
    "g1_is_correct_exact",
    WITH_R + "select event_id, final_answer <> '' and lower(trim(final_answer)) = lower(trim(ground_truth)) "
    "as is_correct from r",
)
def g1(spark, sf):
    df = fx.responses(spark, sf)
    right = g.is_correct_exact(F.col("final_answer"), F.col("ground_truth"))
    return df.select("event_id", right.alias("is_correct"))


# Prices of orders in six notations (form 5 is not a number, form 6 is plain); the value behind the
# notation is the oracle.
NUMBERS = (
    "select o_orderkey, o_orderkey % 7 as form, cast(floor(o_totalprice) as bigint) as whole, "
    "cast(floor(o_totalprice) + o_orderkey % 2 as bigint) as truth_value from orders"
)


def _numbers(spark, sf):
    df = spark.sql(NUMBERS.replace("from orders", "from {orders}"), orders=fx.table(spark, sf, "orders"))
    text = F.col("whole").cast("string")
    commas = F.regexp_replace(text, r"(?<=\d)(?=(\d{3})+$)", ",")
    answer = (
        F.when(F.col("form") == 0, F.concat(F.lit("$"), commas, F.lit(".00")))
        .when(F.col("form") == 1, F.concat(text, F.lit(".0")))
        .when(F.col("form") == 2, F.concat(F.lit("\\frac{"), (F.col("whole") * 2).cast("string"), F.lit("}{2}")))
        .when(F.col("form") == 3, F.concat((F.col("whole") * 4).cast("string"), F.lit("/4")))
        .when(F.col("form") == 4, F.concat(F.lit("\\text{"), text, F.lit("}")))
        .when(F.col("form") == 5, F.concat(F.lit("x"), text))
        .otherwise(text)
    )
    return df.select("o_orderkey", answer.alias("final_answer"), F.col("truth_value").cast("string").alias("ground_truth"))


@query(
    "g2_is_correct_equivalent",
    f"select o_orderkey, form <> 5 and whole = truth_value as is_correct from ({NUMBERS})",
)
def g2(spark, sf):
    right = g.is_correct_equivalent(F.col("final_answer"), F.col("ground_truth"))
    return _numbers(spark, sf).select("o_orderkey", right.alias("is_correct"))


@query(
    "g3_grade_all",
    f"select count(*) as rows, count(*) filter (where form = 6 and whole = truth_value) "
    "as exact_correct, count(*) filter (where form <> 5 and whole = truth_value) as numeric_correct, "
    "count(*) filter (where form <> 5 and whole = truth_value) as any_correct, "
    f"count(*) filter (where not (form <> 5 and whole = truth_value)) as all_failed from ({NUMBERS})",
)
def g3(spark, sf):
    graded = og.grade_all(_numbers(spark, sf), {"exact": g.same_text, "numeric": g.equivalent})
    return og.grader_totals(graded, ["exact", "numeric"])


@query(
    "g3_grade_distinct",
    f"select o_orderkey, form <> 5 and whole = truth_value as is_correct from ({NUMBERS})",
)
def g3_distinct(spark, sf):
    return og.grade_distinct(_numbers(spark, sf), g.equivalent).select("o_orderkey", "is_correct")


# Prices in hundredths or, in forms 3 and 4, in three-hundredths, in seven notations of one number.
FORMS = (
    "select o_orderkey, o_custkey, cast(o_orderkey % 7 as int) as form, cast(floor(o_totalprice * 100) as bigint) as cents, "
    "cast(case when o_orderkey % 7 in (3, 4) then 300 else 100 end as bigint) as parts from orders"
)
# The same numbers by arithmetic: a decimal of 18 places without its zeros, or the reduced fraction.
FORM_SQL = (
    f"with f as ({FORMS}), g as (select *, gcd(cents, parts) as d from f), "
    "h as (select *, cast(cents // d as hugeint) as p, parts // d as q from g), "
    "i as (select *, cast(p * (1000000000000000000 // q) as varchar) as m from h), "
    "k as (select *, rtrim(m, '0') as s from i), "
    "n as (select o_orderkey, o_custkey, case when cents = 0 then '0e0' when 1000000000000000000 % q = 0 "
    "then s || 'e' || cast(len(m) - len(s) - 18 as varchar) else cast(p as varchar) || '/' || cast(q as varchar) end as number_form from k) "
)


def _forms(spark, sf):
    df = spark.sql(FORMS.replace("from orders", "from {orders}"), orders=fx.table(spark, sf, "orders"))
    cents = F.col("cents").cast("string")
    whole, rest = F.expr("cast(cents div 100 as string)"), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    answer = (
        F.when(F.col("form") == 0, F.concat(F.lit("$"), whole, F.lit("."), rest))
        .when(F.col("form") == 1, F.concat(cents, F.lit("/100")))
        .when(F.col("form") == 2, F.concat(F.lit("\\frac{"), cents, F.lit("}{100.0}")))
        .when(F.col("form") == 3, F.concat(F.lit("\\dfrac{"), cents, F.lit("}{300}")))
        .when(F.col("form") == 4, F.concat((F.col("cents") * 2).cast("string"), F.lit("/600")))
        .when(F.col("form") == 5, F.concat(cents, F.lit("\\%")))
        .otherwise(F.concat(cents, F.lit("e-2")))
    )
    return df.select("o_orderkey", "o_custkey", answer.alias("answer"))


@query("g2_number_form", FORM_SQL + "select o_orderkey, number_form from n")
def g2_number_form(spark, sf):
    return _forms(spark, sf).select("o_orderkey", g.number_form(F.col("answer")).alias("number_form"))


@query(
    "g3_answer_classes",
    FORM_SQL + "select o_custkey % 10 as customer, number_form as answer_key, count(*) as answers from n group by all",
)
def g3_answer_classes(spark, sf):
    customer = (F.col("o_custkey") % 10).alias("customer")
    return og.answer_classes(_forms(spark, sf).select(customer, "answer"), ["customer"], "answer").select("customer", "answer_key", "answers")


@query(
    "g4_grader_agreement",
    f"with n as (select form = 6 and whole = truth_value as e, form <> 5 and whole = truth_value as m from ({NUMBERS})) "
    "select count(*) as total, count(*) filter (where e and m) as both_correct, "
    "count(*) filter (where not e and not m) as both_wrong, count(*) filter (where e and not m) as only_exact, "
    "count(*) filter (where not e and m) as only_equivalent, "
    "round(count(*) filter (where e and m) * 100e0 / count(*), 6) as both_correct_pct, "
    "round(count(*) filter (where not e and not m) * 100e0 / count(*), 6) as both_wrong_pct, "
    "round(count(*) filter (where e and not m) * 100e0 / count(*), 6) as only_exact_pct, "
    "round(count(*) filter (where not e and m) * 100e0 / count(*), 6) as only_equivalent_pct from n",
)
def g4(spark, sf):
    a, b = F.col("final_answer"), F.col("ground_truth")
    graded = _numbers(spark, sf).withColumns(
        {"is_correct_exact": g.is_correct_exact(a, b), "is_correct_equivalent": g.is_correct_equivalent(a, b)}
    )
    return rounded(og.grader_agreement(graded))


@query(
    "g5_reward",
    WITH_R + "select event_id, cast(case when lower(expected_answer) = lower(ground_truth) then 1 else 0 end "
    "as double) as reward, cast(case when lower(trim(coalesce(final_answer, ''))) = lower(ground_truth) "
    "then 1 else 0 end as double) as whole_text_reward from r",
)
def g5(spark, sf):
    truth = F.col("ground_truth")
    return fx.responses(spark, sf).select(
        "event_id", g.reward(t.content_for_row(TEXT()), truth).alias("reward"),
        g.reward_whole_text(F.col("final_answer"), truth).alias("whole_text_reward"),
    )


@query(
    "g5_reward_list",
    WITH_R + "select event_id, cast(case when lower(expected_answer) = lower(ground_truth) then 1 else 0 end "
    "as double) as first_reward, 1e0 as second_reward, "
    "cast(case when ground_truth = 'click' then 1 else 0 end as double) as unpaired_reward from r",
)
def g5_list(spark, sf):
    content = F.coalesce(t.content_for_row(TEXT()), F.lit(""))
    # As a stored table: array lambdas are not compiled and would derive the text again and again.
    df = cut_lineage(
        fx.responses(spark, sf).select("event_id", "ground_truth", content.alias("content")), "contents"
    )
    truth = F.col("ground_truth")
    paired = g.reward_list(F.array("content", F.lit("\\boxed{k}")), F.array(truth, F.lit("K")))
    unpaired = g.reward_list(F.array(F.lit("\\boxed{click}")), F.array(truth, F.lit("K")))
    return df.select(
        "event_id", paired[0].alias("first_reward"), paired[1].alias("second_reward"),
        unpaired[0].alias("unpaired_reward"),
    )


@query(
    "g6_count_correct",
    WITH_R + "select problem_id, cast(count(*) filter (where is_correct) as bigint) as correct_count from r group by problem_id",
)
def g6(spark, sf):
    return og.count_correct(fx.responses(spark, sf), ["problem_id"])
