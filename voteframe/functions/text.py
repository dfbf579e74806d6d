"""Text extraction as column expressions. Everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Markers, patterns and the whitespace set that string stripping removes.
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
BOX_OPEN = "\\boxed{"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
FIRST_BOX_PATTERN = r"\\boxed\{([^}]+)\}"
SECOND_BOX_PATTERN = r"\\boxed\{((?:[^}]|\\\})*)\}"
LABELLED_ANSWER_PATTERN = r"(?i)(?:최종\s*답|final\s*answer|답)[:\s]*([^\n]+)"
THEREFORE_PATTERN = r"(?i)therefore[,:\s]+([^\n]+)"
TRAILING_EQUALS_PATTERN = r"=\s*([0-9.,]+)\s*$"
DIGIT_NUMBER_PATTERN = r"-?\d+\.?\d*"
PLAIN_NUMBER_PATTERN = r"-?[0-9]+\.?[0-9]*"
WORDS_TO_TOKENS = 1.3


SHORT_BOX = 256


def _box_pattern(levels: int) -> str:
    """Anchored pattern of a box body with balanced, unescaped braces up to ``levels`` deep."""
    plain = r"[^{}]++|(?<=\\)[{}]"
    body = f"(?:{plain})*+"
    for _ in range(levels):
        body = rf"(?:{plain}|\{{{body}(?<!\\)\}})*+"
    return rf"^({body})(?<!\\)\}}"


SHORT_BOX_PATTERN = _box_pattern(3)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def reasoning_content(text: Column) -> Column:
    """Text between the first opening marker and the first closing marker after it; '' if absent."""
    start = F.instr(text, THINK_OPEN)
    rest = F.substr(text, start + F.lit(len(THINK_OPEN)))
    stop = F.instr(rest, THINK_CLOSE)
    found = (start > 0) & (stop > 0)
    return F.when(found, strip(F.substr(rest, F.lit(1), stop - F.lit(1)))).otherwise(F.lit(""))


def content_strict(text: Column) -> Column:
    """Text after the first closing marker; '' without a marker."""
    pos = F.instr(text, THINK_CLOSE)
    after = strip(F.substr(text, pos + F.lit(len(THINK_CLOSE))))
    return F.when(pos > 0, after).otherwise(F.lit(""))


def content_lenient(text: Column) -> Column:
    """As :func:`content_strict`, but without a marker the whole stripped text ('' for null)."""
    pos = F.instr(text, THINK_CLOSE)
    after = strip(F.substr(text, pos + F.lit(len(THINK_CLOSE))))
    return F.when(pos > 0, after).otherwise(F.coalesce(strip(text), F.lit("")))


def content_for_row(text: Column, mode: str = "reasoning", thinking: bool = True) -> Column:
    """Which part of a response is its content.

    ``reasoning``: text after the marker if there is reasoning, else the untouched response.
    ``strict``: always the text after the marker.
    ``evaluation``: with ``thinking`` the lenient content, or the response where that is empty;
    without ``thinking`` the response itself.
    """
    if mode == "reasoning":
        return F.when(reasoning_content(text) != "", content_strict(text)).otherwise(text)
    if mode == "strict":
        return content_strict(text)
    if mode == "evaluation":
        if not thinking:
            return text
        lenient = content_lenient(text)
        return F.when(lenient != "", lenient).otherwise(text)
    raise ValueError(f"unknown content mode: {mode}")


def final_answer(content: Column) -> Column:
    r"""Content of the last ``\boxed{...}`` with balanced braces, '' if absent or unbalanced.

    A compiled pattern reads boxes that close early and nest at most three levels, which is nearly
    all of them. For the rest the whole text after the last box is split at its unescaped closing
    braces, and the answer ends at the first piece after which the braces balance; that work is
    proportional to the number of braces, not characters.
    """
    text = strip(content)
    tail = F.substring_index(text, BOX_OPEN, -1)
    start = F.substring(tail, 1, SHORT_BOX)

    def close_box(pieces: Column) -> Column:
        closed = F.slice(pieces, F.lit(1), F.size(pieces) - F.lit(1))
        start = F.struct(F.lit(0).alias("i"), F.lit(1).alias("depth"), F.lit(0).alias("hit"))

        def step(acc: Column, piece: Column) -> Column:
            opened = F.size(F.split(piece, r"(?<!\\)\{")) - F.lit(1)
            i = acc["i"] + F.lit(1)
            depth = acc["depth"] + opened - F.lit(1)
            hit = F.when(acc["hit"] > 0, acc["hit"]).when(depth == 0, i).otherwise(F.lit(0))
            return F.struct(i.alias("i"), depth.alias("depth"), hit.alias("hit"))

        hit = F.aggregate(closed, start, step, lambda acc: acc["hit"])
        return let(
            hit,
            lambda h: F.when(
                h > 0, strip(F.array_join(F.slice(pieces, F.lit(1), h), "}"))
            ).otherwise(F.lit("")),
        )

    deep = let(F.split(tail, r"(?<!\\)\}"), close_box)
    return (
        F.when(F.coalesce(F.instr(text, BOX_OPEN), F.lit(0)) == 0, F.lit(""))
        .when(start.rlike(SHORT_BOX_PATTERN), strip(F.regexp_extract(start, SHORT_BOX_PATTERN, 1)))
        .otherwise(deep)
    )


def _last_number(line: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), F.lit(-1))


def _last_line(text: Column) -> Column:
    return F.element_at(F.split(text, "\n"), -1)


def final_answer_regex(content: Column) -> Column:
    """First box without nested braces, else the last number on the last line, else ''."""
    first = F.regexp_substr(content, F.lit(FIRST_BOX_PATTERN))
    second = F.regexp_substr(content, F.lit(SECOND_BOX_PATTERN))
    number = _last_number(strip(_last_line(strip(content))), DIGIT_NUMBER_PATTERN)
    return (
        F.when(first.isNotNull(), strip(F.regexp_extract(content, FIRST_BOX_PATTERN, 1)))
        .when(second.isNotNull(), strip(F.regexp_extract(content, SECOND_BOX_PATTERN, 1)))
        .otherwise(F.coalesce(number, F.lit("")))
    )


def final_answer_fallbacks(content: Column) -> Column:
    r"""Last balanced box with ``\text{x}`` unwrapped, else labelled answers, else the last number
    of the last non-blank line."""
    text = strip(content)
    box = final_answer(text)
    # An existing but empty balanced box is still an answer; an unbalanced one falls through.
    has_box = F.instr(text, BOX_OPEN) > 0
    empty_box = F.regexp_like(
        F.substring_index(text, BOX_OPEN, -1), F.lit(r"^\s*\}")
    )
    unwrapped = F.regexp_replace(box, r"\\text\{([^}]+)\}", "$1")

    def labelled(pattern: str) -> Column:
        hit = F.regexp_substr(text, F.lit(pattern)).isNotNull()
        return F.when(hit, strip(F.regexp_extract(text, pattern, 1)))

    number = _last_number(_last_line(text), PLAIN_NUMBER_PATTERN)
    return F.when(has_box & ((box != "") | empty_box), unwrapped).otherwise(
        F.coalesce(
            labelled(LABELLED_ANSWER_PATTERN),
            labelled(THEREFORE_PATTERN),
            labelled(TRAILING_EQUALS_PATTERN),
            number,
            F.lit(""),
        )
    )


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for null or blank."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]++")), F.lit(0))


def token_count(
    text: Column,
    method: str = "words",
    tokenizer: Callable[[Column], Column] | None = None,
) -> Column:
    """Token count by word count, scaled word count, or a caller-supplied column function (for
    example a vectorised UDF around a tokenizer); a null tokenizer result falls back to words."""
    words = word_count(text)
    if method == "words":
        return words
    if method == "scaled":
        return F.floor(words * F.lit(WORDS_TO_TOKENS)).cast("int")
    if method == "tokenizer":
        if tokenizer is None:
            raise ValueError("method 'tokenizer' needs a tokenizer")
        counted = F.coalesce(tokenizer(text).cast("int"), words)
        return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(counted)
    raise ValueError(f"unknown token count method: {method}")


def post_marker_tokens(text: Column) -> Column:
    """Scaled word count after the closing marker; 0 without one."""
    return token_count(content_strict(text), "scaled")


def chat_completion_text(messages: Column) -> Column:
    """First message's content of a chat-style completion."""
    return F.get(messages, F.lit(0))["content"]


def lacks_marker(text: Column) -> Column:
    """True where the closing marker is missing; null text counts as missing."""
    return F.coalesce(F.instr(text, THINK_CLOSE), F.lit(0)) == 0


def fixed_text(value: Column, digits: int) -> Column:
    """A double with fixed decimals, rounded half to even on its exact binary value.

    The JVM formatter rounds the shortest decimal form half up, which differs for values such as
    3.3125. Here the scaled value is kept as an exact sum of two doubles (the value is split into
    halves short enough for their products with the scale to be exact).
    """
    scale = float(10**digits)

    def write(x: Column) -> Column:
        size = F.abs(x)
        spread = size * F.lit(134217729.0)
        high = spread - (spread - size)
        a, b = high * F.lit(scale), (size - high) * F.lit(scale)
        whole = F.floor(a + b)
        beyond = (a - whole - F.lit(0.5)) + b
        up = F.when(beyond > 0, F.lit(1)).when(beyond < 0, F.lit(0)).otherwise(F.pmod(whole, F.lit(2)))
        sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
        text = let(
            (whole + up).cast("bigint"),
            lambda n: F.concat(
                sign, F.floor(n / F.lit(10**digits)).cast("string"), F.lit("."),
                F.lpad(F.pmod(n, F.lit(10**digits)).cast("string"), digits, "0"),
            ),
        )
        return (
            F.when(F.isnan(x), F.lit("nan"))
            .when(size < 1e11, text)
            .otherwise(F.format_string(f"%.{digits}f", x))
        )

    return let(value.cast("double"), write)
