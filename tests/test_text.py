"""Text extraction and grading on hand-made cases."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from voteframe.functions import grading as g, text as t
from voteframe.operators import grading as og


def evaluate(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = {
    "\\boxed{1} and \\boxed{2}": "2",
    "\\boxed{\\frac{1}{2}} rest }": "\\frac{1}{2}",
    "\\boxed{a\\}b}": "a\\}b",
    "\\boxed{a\\{b}": "a\\{b",
    "\\boxed{ x }": "x",
    "\\boxed{}": "",
    "\\boxed{{a}{b{c}}}": "{a}{b{c}}",
    "\\boxed{1} then \\boxed{open": "",
    "\\boxed{1} then \\boxed{o{pen}": "",
    "no box": "",
    "": "",
    "  \\boxed{5}\n": "5",
    "\\boxed{}}": "",
    "\\fbox{3} \\boxed{4}}}": "4",
}


def test_final_answer(spark):
    assert evaluate(spark, t.final_answer, CASES) == list(CASES.values())


def test_reasoning_and_content(spark):
    texts = [
        "<think> a </think> b ", "x</think>y", "<think>open", "</think><think>z</think>w", "plain ", None,
        "<think></think>\u3000b\u00a0\n",
    ]
    assert evaluate(spark, lambda c: F.coalesce(t.reasoning_content(c), F.lit("")), texts) == [
        "a", "", "", "z", "", "", "",
    ]
    assert evaluate(spark, t.content_strict, texts) == ["b", "y", "", "<think>z</think>w", "", "", "b"]
    assert evaluate(spark, t.content_lenient, texts) == [
        "b", "y", "<think>open", "<think>z</think>w", "plain", "", "b",
    ]
    assert evaluate(spark, lambda c: t.content_for_row(c, "reasoning"), texts) == [
        "b", "x</think>y", "<think>open", "<think>z</think>w", "plain ", None, "<think></think>\u3000b\u00a0\n",
    ]


def test_final_answer_regex(spark):
    texts = ["\\boxed{\\frac{1}{2}}", "\\boxed{}7\nlast -3.5 of 4", "a 1\nb 22", "none", "\\boxed{a} \\boxed{b}"]
    assert evaluate(spark, t.final_answer_regex, texts) == ["\\frac{1", "", "22", "", "a"]


def test_fallbacks(spark):
    cases = {
        "\\boxed{\\text{yes}}": "yes",
        "\\boxed{} final answer: 9": "",
        "final answer: 42 units\nmore": "42 units",
        "답: 7": "7",
        "THEREFORE, x is 3": "x is 3",
        "so y = 3.5 ": "3.5",
        "first 1\n\nthen -2.5 or 8\n  ": "8",
        "nothing": "",
    }
    assert evaluate(spark, t.final_answer_fallbacks, cases) == list(cases.values())


def test_token_counts(spark):
    texts = ["one two  three\n", "", None, " \t ", "a\u00a0b\u3000c"]
    assert evaluate(spark, t.token_count, texts) == [len((x or "").split()) for x in texts]
    assert evaluate(spark, lambda c: t.token_count(c, "scaled"), texts) == [
        int(len((x or "").split()) * 1.3) for x in texts
    ]
    by_length = lambda c: F.when(c != "a\u00a0b\u3000c", F.length(c))
    assert evaluate(spark, lambda c: t.token_count(c, "tokenizer", by_length), texts) == [15, 0, 0, 3, 3]
    with pytest.raises(ValueError):
        t.token_count(F.col("v"), "other")


def test_fixed_text_matches_c_formatting(spark):
    values = [3.3125, 0.0005, 1.0005, 1.0015, 2.5, 0.125, -0.0625, 12345.67895, 0.0, 99.9996]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (3, 4):
        got = [r.o for r in df.select(t.fixed_text(F.col("v"), digits).alias("o")).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]


def test_graders(spark):
    pairs = [
        ("$1,234.50", "1234.5", True), ("\\frac{1}{2}", "0.5", True), ("-\\dfrac{3}{4}", "-0.75", True),
        ("1/3", "0.3333333333", True), ("1/0", "1", False), ("1/0", "1/0", True), ("\\text{ yes }", "yes", False),
        ("YES", " yes ", True), ("", "", True), ("nan", "NaN", True), ("nan", "1", False), ("12", "12.0", True),
        ("1,2", "12", False), ("5", "6", False), (None, "1", False), ("1e3", "1000", True), ("\\$5", "5", True),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = [
        (r.e, r.g)
        for r in df.select(
            "i", g.equivalent(F.col("a"), F.col("b")).alias("e"),
            g.is_correct_equivalent(F.col("a"), F.col("b")).alias("g"),
        ).orderBy("i").collect()
    ]
    assert [e for e, _ in got] == [w for *_, w in pairs]
    assert [x for _, x in got] == [w and bool(a) for a, _, w in pairs]


def test_normal_forms_are_exact(spark):
    rng = random.Random(8)
    same = ["0.5", "1/2", "\\frac{1}{2}", "50\\%", "50%", "5e-1", ".5", "-\\dfrac{-1}{2}", "2.5/5", "$0.50"]
    cases = [(t, Fraction(1, 2)) for t in same]
    for _ in range(400):
        p, q = rng.randrange(-10**rng.randint(1, 15), 10**rng.randint(1, 15)), rng.randrange(1, 10 ** rng.randint(1, 15))
        cases += [(f"{p}/{q}", Fraction(p, q)), (f"\\frac{{{p * 7}}}{{{q * 7}}}", Fraction(p, q))]
        cases += [(f"{p}.{q}", Fraction(f"{p}.{q}")), (f"{p}e{q % 40 - 20}", p * Fraction(10) ** (q % 40 - 20))]
    cases += [("1" * 60, Fraction("1" * 60)), ("1" * 60 + ".00", Fraction("1" * 60)), ("1" * 59 + "2", Fraction("1" * 59 + "2"))]
    forms = evaluate(spark, g.number_form, [t for t, _ in cases])
    by_value, by_form = {}, {}
    for form, (text, value) in zip(forms, cases):
        assert form is not None, text
        assert by_value.setdefault(value, form) == form and by_form.setdefault(form, value) == value, text
    assert evaluate(spark, g.number_form, ["", None, "x", "1/0", "0/0", "3 4", "1,2", "nan", "1e", "5--"]) == [None] * 10


def test_exact_grader_and_answer_classes(spark):
    pairs = [("1/3", "0.3333333333", False), ("1/3", "2/6", True), ("75\\%", "\\frac{3}{4}", True), ("YES", "yes ", True), ("a", "b", False), (None, "1", False)]
    df = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert [r.x for r in df.select(g.equivalent_exact(F.col("a"), F.col("b")).alias("x")).collect()] == [w for *_, w in pairs]
    answers = [("k", t) for t in ("1/2", "0.5", "50%", " X", "x", "1/3", None, None)]
    got = og.answer_classes(spark.createDataFrame(answers, "problem string, final_answer string"), ["problem"]).collect()
    assert {(r.answer_key, r.answers) for r in got} == {("5e-1", 3), ("x", 2), ("1/3", 1), (None, 2)}


def test_a_pair_is_graded_with_few_regular_expressions(spark):
    df = spark.createDataFrame([("1", "2")], "a string, b string")
    text = df.select(g.equivalent_exact(F.col("a"), F.col("b")).alias("x"))._jdf.queryExecution().optimizedPlan().expressions().toString()
    assert len(re.findall(r"regexp_replace\(|regexp_extract\(|RLIKE", text)) < 10


def boxed(text):
    """Character-by-character reading of the last box, as the specification words it."""
    text = text.strip()
    start = text.rfind("\\boxed{")
    if start < 0:
        return ""
    start += len("\\boxed{")
    depth, i = 1, start
    while i < len(text) and depth:
        if text[i] in "{}" and text[i - 1] != "\\":
            depth += 1 if text[i] == "{" else -1
        i += 1
    return text[start:i - 1].strip() if depth == 0 else ""


def test_final_answer_on_random_markup(spark):
    rng = random.Random(4)
    parts = ["{", "}", "\\", "{", "}", "a", " ", "\\{", "\\}", "\\\\", "x" * 90, "\\boxed{", "\n"]
    texts = ["\\boxed{" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += ["\\boxed{" + "{" * n + "x" + "}" * m for n in range(8) for m in range(10)]
    texts += ["\\boxed{" + "{a}" * 3000 + "}", "\\boxed{" + "{a}" * 3000, "\\boxed{" + "y" * 5000 + "}"]
    assert evaluate(spark, t.final_answer, texts) == [boxed(x) for x in texts]
