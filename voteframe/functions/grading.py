"""Answer grading as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from voteframe.functions.text import final_answer, let, strip

# A grader compares an answer column with a truth column and yields a boolean column.
Grader = Callable[[Column, Column], Column]

NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
FRACTION_PATTERN = r"^([+-]?)\\[dt]?frac\{([+-]?\d+\.?\d*)\}\{([+-]?\d+\.?\d*)\}$"
SLASH_PATTERN = r"^([+-]?\d+\.?\d*)/(\d+\.?\d*)$"
INTEGER_PATTERN = r"^[+-]?\d+$"
FORM_FRACTION_PATTERN = r"^([+-]?)\\[dt]?frac\{([+-]?\d+\.?\d*)\}\{([+-]?\d+\.?\d*)\}(?=\\?%?$)"
FORM_PATTERN = r"^(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]{0,2}\d+\.?\d*/[+-]?\d+\.?\d*)$"
# Fractions are reduced if both numbers have at most this many digits.
EXACT_DIGITS = 18
TOLERANCE = 1e-9


def same_text(answer: Column, truth: Column) -> Column:
    """Case-insensitive equality of stripped text; empty equals empty."""
    return F.coalesce(F.lower(strip(answer)) == F.lower(strip(truth)), F.lit(False))


def is_correct_exact(answer: Column, truth: Column) -> Column:
    """As :func:`same_text`, but a null or empty answer is never right."""
    return (F.coalesce(answer, F.lit("")) != "") & same_text(answer, truth)


def clean_number_text(text: Column) -> Column:
    r"""Drop currency signs, thousands separators, ``\text{}`` wrappers, and spaces that do not stand
    between two digits."""
    plain = F.regexp_replace(strip(text), r"\\text\{([^}]*)\}", "$1")
    return F.regexp_replace(plain, r"\\?\$|\\[,!;]|(?<=\d),(?=\d{3})|(?<!\d)\s+|\s+(?!\d)", "")


def _gcd(a: Column, b: Column, digits: Column) -> Column:
    """Greatest common divisor of two whole numbers, the smaller of which has so many digits: Euclid's
    algorithm takes at most five steps a digit, and one to put the numbers in order."""
    start = F.struct(a.alias("a"), b.alias("b"))

    def step(acc: Column, _: Column) -> Column:
        rest = F.struct(acc["b"].alias("a"), F.try_mod(acc["a"], acc["b"]).alias("b"))
        return F.when(acc["b"] > 0, rest).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), digits * 5), start, step)["a"]


def _power_form(sign: Column, digits: Column, power: Column) -> Column:
    """``digits`` times a power of ten, without zeros at the end."""
    kept = F.rtrim(digits, F.lit("0"))
    return F.concat(sign, kept, F.lit("e"), (power + F.length(digits) - F.length(kept)).cast("string"))


def _reduced_form(sign: Column, top: Column, bottom: Column) -> Column:
    """The form of a quotient of two whole numbers that are given as digits."""
    unit = F.lit(10**EXACT_DIGITS).cast("bigint")

    def reduced(f: Column) -> Column:
        p, q = F.call_function("div", f["p"], f["g"]), F.call_function("div", f["q"], f["g"])
        whole = p.cast(f"decimal({EXACT_DIGITS},0)") * F.call_function("div", unit, q).cast(f"decimal({EXACT_DIGITS + 1},0)")
        return F.when(unit % q == 0, _power_form(sign, whole.cast("string"), F.lit(-EXACT_DIGITS))).otherwise(
            F.concat(sign, p.cast("string"), F.lit("/"), q.cast("string"))
        )

    p, q = top.try_cast("bigint"), bottom.try_cast("bigint")
    short = (F.length(top) <= EXACT_DIGITS) & (F.length(bottom) <= EXACT_DIGITS)
    exact = let(F.struct(p.alias("p"), q.alias("q"), _gcd(p, q, F.least(F.length(top), F.length(bottom))).alias("g")), reduced)
    return F.when(short, exact).otherwise(F.concat(sign, top, F.lit("/"), bottom))


def number_form(text: Column) -> Column:
    r"""The normal form of a number: equal numbers have equal forms, so it can be compared, joined and
    grouped by. Null for anything that is no number, and for a division by zero.

    Whole numbers, decimals and powers of ten become ``<digits>e<power>`` without needless zeros, at any
    length; ``1/2``, ``\frac{1}{2}`` and ``50\%`` become ``5e-1`` like ``0.5``. A fraction that no decimal
    of 18 places equals is reduced to ``p/q``. Fractions with more than 18 digits above or below are not
    reduced.
    """

    def parts(t: Column) -> Column:
        percent = F.when(t.endswith("%"), F.lit(2)).otherwise(F.lit(0))
        return let(F.upper(F.rtrim(t, F.lit("\\%"))), lambda number: F.when(
            number.rlike(FORM_PATTERN), let(F.split(F.translate(number, "E", "/"), "/"), lambda p: split_number(number, p, percent))
        ))

    def split_number(number: Column, p: Column, percent: Column) -> Column:
        top, second, quotient = p[0], F.get(p, F.lit(1)), number.contains("/")
        digits = lambda part: F.ltrim(F.translate(part, "+-.", ""), F.lit("0"))
        places = lambda part: F.when(part.contains("."), F.length(part) - F.instr(part, ".")).otherwise(F.lit(0))
        minus = F.when(quotient, (F.length(number) - F.length(F.translate(number, "-", ""))) % 2 == 1).otherwise(top.startswith("-"))
        shift = F.when(quotient, places(second)).when(second.isNull(), F.lit(0)).otherwise(second.try_cast("int"))
        return F.struct(
            F.when(minus, F.lit("-")).otherwise(F.lit("")).alias("sign"),
            digits(top).alias("top"),
            F.when(quotient, digits(second)).otherwise(F.lit("1")).alias("bottom"),
            (shift - places(top) - percent).alias("power"),
        )

    def form(n: Column) -> Column:
        tens = F.rtrim(n["bottom"], F.lit("0")) == "1"
        above = F.concat(n["top"], F.repeat(F.lit("0"), F.greatest(n["power"], F.lit(0))))
        below = F.concat(n["bottom"], F.repeat(F.lit("0"), F.greatest(-n["power"], F.lit(0))))
        return (
            F.when(n.isNull() | (n["bottom"] == "") | n["power"].isNull(), F.lit(None).cast("string"))
            .when(n["top"] == "", F.lit("0e0"))
            .when(tens, _power_form(n["sign"], n["top"], n["power"] - F.length(n["bottom"]) + 1))
            .otherwise(_reduced_form(n["sign"], above, below))
        )

    slash = F.regexp_replace(clean_number_text(text), FORM_FRACTION_PATTERN, "$1$2/$3")
    return let(slash, lambda t: let(F.when(~t.contains("."), t.try_cast("bigint")), lambda whole: (
        F.when(whole.isNull(), let(parts(t), form)).when(whole == 0, F.lit("0e0"))
        .otherwise(_power_form(F.lit(""), whole.cast("string"), F.lit(0)))
    )))


def answer_key(text: Column) -> Column:
    """The number's normal form, or else the stripped text in small letters: answers with equal keys are
    the same answer, exactly and transitively. Null for null."""
    return F.coalesce(number_form(text), F.lower(strip(text)))


def _has_digit(text: Column) -> Column:
    return F.translate(text, "0123456789", "") != text


def equivalent_exact(answer: Column, truth: Column) -> Column:
    """Equal as text or as numbers, with no tolerance: ``1/3`` is not ``0.3333333333``. No guard for
    empty answers."""
    equal = _has_digit(answer) & _has_digit(truth) & (number_form(answer) == number_form(truth))
    return same_text(answer, truth) | F.coalesce(equal, F.lit(False))


def numeric_value(text: Column) -> Column:
    """The value of a plain number or a simple fraction; null for anything else."""
    t = clean_number_text(text)
    num = F.regexp_extract(t, FRACTION_PATTERN, 2).try_cast("double")
    den = F.regexp_extract(t, FRACTION_PATTERN, 3).try_cast("double")
    sign = F.when(F.regexp_extract(t, FRACTION_PATTERN, 1) == "-", F.lit(-1.0)).otherwise(1.0)
    top = F.regexp_extract(t, SLASH_PATTERN, 1).try_cast("double")
    bottom = F.regexp_extract(t, SLASH_PATTERN, 2).try_cast("double")
    return (
        F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))
        .when(t.rlike(FRACTION_PATTERN), sign * F.try_divide(num, den))
        .when(t.rlike(SLASH_PATTERN), F.try_divide(top, bottom))
    )


def integer_text(text: Column) -> Column:
    """An integer of any length without plus sign and leading zeros; null for anything else."""
    t = clean_number_text(text)
    digits = F.regexp_replace(F.regexp_replace(t, r"^[+-]", ""), r"^0+(?=\d)", "")
    signed = F.when(t.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    return F.when(t.rlike(INTEGER_PATTERN), signed)


def equivalent(answer: Column, truth: Column) -> Column:
    """Equal as text, as integers digit by digit, or as other numbers within a relative tolerance.
    No guard for empty answers."""
    a, b = numeric_value(answer), numeric_value(truth)
    close = F.abs(a - b) <= F.lit(TOLERANCE) * F.greatest(F.lit(1.0), F.abs(b))
    equal = F.coalesce(integer_text(answer) == integer_text(truth), close)
    return same_text(answer, truth) | F.coalesce(equal, F.lit(False))


def is_correct_equivalent(answer: Column, truth: Column, grader: Grader = equivalent) -> Column:
    """``grader`` with the rule that a null or empty answer is never right."""
    filled = F.coalesce(answer, F.lit("")) != ""
    return filled & F.coalesce(grader(answer, truth), F.lit(False))


def reward(content: Column, truth: Column, grader: Grader = equivalent) -> Column:
    """1.0 where the boxed answer of ``content`` is right, else 0.0."""
    right = F.coalesce(grader(final_answer(content), truth), F.lit(False))
    return right.cast("double")


def reward_list(contents: Column, truths: Column, grader: Grader = equivalent) -> Column:
    """Rewards for an array of completions: paired with truths of the same length, otherwise every
    completion is compared with the first truth."""
    paired = F.size(contents) == F.size(truths)

    def one(content: Column, i: Column) -> Column:
        pos = F.when(paired, i + F.lit(1)).otherwise(F.lit(1))
        truth = F.try_element_at(truths, pos.cast("int"))
        right = let(final_answer(content), lambda answer: grader(answer, truth))
        return F.coalesce(right, F.lit(False)).cast("double")

    return F.transform(contents, one)


def reward_whole_text(response: Column, truth: Column) -> Column:
    """Legacy reward: the whole response must equal the truth."""
    return same_text(response, truth).cast("double")
