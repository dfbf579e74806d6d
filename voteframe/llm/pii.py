"""Personal data and secrets replaced by surrogates.

Entities are found by pattern, checked where their type has a rule (IBAN check digits, IPv6 form), and
each is replaced by one of the same type and format: digits by digits, letters by letters of the same
script, case and accent. The replacement is a keyed permutation of all values of a format, so equal
entities get equal surrogates in every document and different entities different ones, without a table
of what has been handed out. Spelling variants of one entity (spaces, case, dashes) share a core of
letters and digits, and so a surrogate. The permutation is a Feistel network over the even and the odd
places, so its work grows with the length of a value and no longer; it leaves no value as it is that
has a symbol to change.

Names are found after a title, after words that introduce a person, from a given name of a fixed list
and its surname, and from the address of an e-mail in the same document. They are replaced part by
part, and a detected name's parts are replaced wherever else the document mentions them. A listed given
name becomes another of its gender, script and ending; other parts change vowels into vowels and keep their last
letter, and never become a listed given name.

``collisions`` counts, over a whole corpus, surrogates that two entities share, surrogates that are
their own original, and surrogates that are the original of another entity.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voteframe.llm.common import map_arrow, slices

KEY = "surrogates"
#: Rounds of the network; in each, both halves move once.
ROUNDS = 4
#: Words before a name.
TITLES = (
    "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Don Doña г-н г-жа Господин Госпожа Κύριος Κυρία"
).split()
#: Words that introduce a person.
CUES = "my name is|name:|author:|signed by|written by|regards,|sincerely,|ich heiße|je m'appelle|me llamo|меня зовут|με λένε".split("|")
#: Given names by gender and script, no everyday words among them.
GIVEN = (
    "Anna Maria Mary Elizabeth Jennifer Linda Barbara Susan Jessica Sarah Karen Lisa Nancy Sandra Emily Laura Julia Sofia Emma Olivia Hannah Martha Claudia Monika".split(),
    "John James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Andrew Kevin Brian Peter Paul Carlos Miguel Stefan Hans Pierre".split(),
    "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    "Иван Пётр Александр Сергей Дмитрий Андрей Алексей Михаил Николай Павел".split(),
    "Ελένη Κατερίνα Αικατερίνη Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα".split(),
    "Γιώργος Δημήτρης Κωνσταντίνος Ιωάννης Νίκος Χρήστος Παναγιώτης Βασίλης".split(),
)
_PART = r"[^\W\d_a-zа-яα-ω][^\W\d_]{1,30}"
#: Patterns in order of precedence; a group, if there is one, is the part to replace.
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----([A-Za-z0-9+/=\s]++)-----END",
    "email": r"[\w.+-]{1,64}@(?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24}",
    "access_key": r"\b(?:AKIA|ASIA)([0-9A-Z]{16})\b",
    "api_token": r"\b(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|npm_|hf_)([0-9A-Za-z_-]{16,})",
    "hex_secret": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])",
    "password": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?)([^\s\"']{6,})",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d\d(?: ?[0-9A-Z]){11,30}(?![0-9A-Za-z])",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,8}(?![\w:])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)",
    "id_number": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
}
KINDS = (*PATTERNS, "name")
_COMPILED = {kind: re.compile(p) for kind, p in PATTERNS.items()}
#: What follows a sign of a name; a name after a title may have one part.
_NAME_AFTER = {
    "title": re.compile(rf"\.?[ ]({_PART}(?:[ -]{_PART})*)"),
    "cue": re.compile(rf"\s{{1,3}}({_PART}(?:[ -]{_PART})+)"),
    "given": re.compile(rf"[ ]{_PART}(?:[ -]{_PART})*"),
}
_NEEDS_DIGIT = ("access_key", "hex_secret", "iban", "ipv6", "ip", "card", "phone", "id_number")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]+")
_PART_GAP = re.compile("([ -])")
#: What a text must hold for a pattern to be tried on it.
_NEEDS = {"email": ["@"], "private_key": ["PRIVATE KEY"], "ipv6": [":"], "password": ["password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "apikey"]}
#: The end of an entity whose form must hold, or None.
_VALID = {"iban": lambda text, start, end: _iban_end(text, start, end), "ipv6": lambda text, start, end: end if _is_ipv6(text[start:end]) else None}
#: Alphabets, vowels first.
_SCRIPTS = (("aeiou", "bcdfghjklmnpqrstvwxyz"), ("аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"), ("αεηιουω", "βγδζθκλμνξπρστφχψ"))


def detect(text: str) -> list[tuple[int, int, str]]:
    """Spans ``(start, end, type)`` that do not overlap; an earlier pattern wins. Characters that are
    taken are marked, so the work grows with the text and not with the number of pairs of matches."""
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))

    def take(start: int, end: int, kind: str) -> None:
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            found.append((start, end, kind))

    digits, low = _DIGIT.search(text) is not None, text.lower()
    for kind, pattern in _COMPILED.items():
        if kind in _NEEDS_DIGIT and not digits:
            continue
        if kind in _NEEDS and not any(sign in (low if kind == "password" else text) for sign in _NEEDS[kind]):
            continue
        at = 0
        while m := pattern.search(text, at):
            start, end = m.span(1) if pattern.groups else m.span()
            valid = _VALID[kind](text, start, end) if kind in _VALID else end
            if valid is not None:
                take(start, valid, kind)
            at = valid or m.end()
    for start, end in _introduced(text):
        take(start, end, "name")
    for start, end in _addressed(text, [text[a:b] for a, b, k in found if k == "email"]):
        take(start, end, "name")
    return sorted(found)


@cache
def _signs() -> ahocorasick.Automaton:
    """One automaton over all signs of a name, so that a text is read once for them."""
    signs = ahocorasick.Automaton()
    for word in (n for names in GIVEN for n in names):
        for form in (word, word.upper()):
            signs.add_word(form, (len(form), "given"))
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            signs.add_word(form, (len(form), "cue"))
    for title in TITLES:
        # The capitals of Ms name a company as a rule.
        for form in {title, title.upper()} - {"MS"}:
            signs.add_word(form, (len(form), "title"))
    signs.make_automaton()
    return signs


def _introduced(text: str) -> Iterator[tuple[int, int]]:
    """Spans of names after titles, after words that introduce a person and from listed given names."""
    for last, (length, sign) in _signs().iter(text):
        start, end = last - length + 1, last + 1
        if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
            continue
        if m := _NAME_AFTER[sign].match(text, end):
            yield (start, m.end()) if sign == "given" else m.span(1)


def _addressed(text: str, emails: list[str]) -> Iterator[tuple[int, int]]:
    """Spans of two or more neighbouring words, none in small letters, that are the parts of the local
    part of one of the addresses, in either order."""
    owners = {frozenset(p for p in re.split(r"[._+-]", e.partition("@")[0].lower()) if len(p) > 1 and p.isalpha()) for e in emails}
    owners = {o for o in owners if len(o) > 1}
    if not owners:
        return
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    lengths = sorted({len(o) for o in owners})
    known = {p for o in owners for p in o}
    for i, (start, _) in enumerate(words):
        if text[start].islower() or text[slice(*words[i])].lower() not in known:
            continue
        for n in lengths:
            run = words[i : i + n]
            near = len(run) == n and all(text[a[1] : b[0]] in (" ", "-") for a, b in zip(run, run[1:]))
            if near and not any(text[a].islower() for a, _ in run) and frozenset(text[a:b].lower() for a, b in run) in owners:
                yield start, run[-1][1]


def _iban_check(country: str, body: str) -> int:
    """The check digits of an account number."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def _iban_end(text: str, start: int, end: int) -> int | None:
    """Where a valid IBAN that begins at ``start`` ends: the longest of the readings that stop at a gap."""
    while end is not None and end > start:
        value = text[start:end].replace(" ", "").lower()
        if len(value) < 15:
            return None
        if int(value[2:4]) == _iban_check(value[:2], value[4:]):
            return end
        gap = text.rfind(" ", start, end)
        end = gap if gap > 0 else None
    return None


def _is_ipv6(value: str) -> bool:
    """An address with three groups or more and a digit; not the one of the machine itself."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return sum(map(bool, value.split(":"))) > 2 and _DIGIT.search(value) is not None


@cache
def _accented(mark: str, base: str) -> str:
    """The characters of an alphabet that exist with these accents in both cases."""
    made = (unicodedata.normalize("NFC", c + mark) for c in base)
    return "".join(c for c in made if len(c) == 1 and len(c.upper()) == 1)


@cache
def _alphabet(c: str, kind: str) -> str:
    """The characters that may replace ``c`` (lower case), itself included."""
    if c.isascii() and c.isdigit():
        return "0123456789"
    if kind in ("hex_secret", "ipv6"):
        return "abcdef"
    for vowels, others in _SCRIPTS:
        if c in vowels or c in others:
            if kind == "name":
                return vowels if c in vowels else others
            return vowels + others
    plain = unicodedata.normalize("NFD", c)
    if len(plain) > 1:
        for vowels, others in _SCRIPTS:
            for base in (vowels, others):
                if plain[0] in base and c in (same := _accented(plain[1:], base)):
                    return "".join(x for x in same if not any(x in v + o for v, o in _SCRIPTS))
    return c


def _luhn(digits: str) -> int:
    """The check digit of a number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def core(value: str) -> str:
    """What the spelling variants of an entity share."""
    return "".join(c for c in value.lower() if c.isalnum())


def _symbols(value: str, kind: str) -> tuple[list[str], list]:
    """The parts of a value that change together, and what each may become."""
    if kind == "ip":
        parts = value.split(".")
        spans = {1: range(10), 2: range(10, 100), 3: range(100, 256)}
        return parts, [[str(n) for n in spans[len(p)]] for p in parts]
    chars = list(core(value))
    fixed: set[int] = set()
    if kind == "card":
        fixed = {0, len(chars) - 1}
    elif kind == "email":
        fixed = set(range(len(chars) - len(core(value.rpartition(".")[2])), len(chars)))
    elif kind == "iban":
        fixed = {0, 1, 2, 3}
    elif kind == "phone" and value.startswith("+"):
        fixed = set(range(len(core(re.match(r"\+\d{1,3}", value)[0]))))
    elif kind == "name":
        at = -1
        for word in re.split("[ -]", value):
            at += len(core(word))
            fixed.add(at)
    return chars, [c if i in fixed else _alphabet(c, kind) for i, c in enumerate(chars)]


def permuted(value: str, kind: str, key: str, turn: int) -> list[str]:
    """A keyed permutation within the format: in each round the symbols at even places are moved within
    their alphabets by a hash of those at odd places, and then the other way round. Then one symbol is
    moved by one place and the rounds are undone, so that no value with a symbol that can move stays
    as it is."""
    symbols, choices = _symbols(value, kind)
    sizes = np.array([len(c) for c in choices], np.int64)
    state = np.array([c.index(s) for s, c in zip(symbols, choices)], np.int64)
    free = np.flatnonzero(sizes > 1)
    halves = (free[::2], free[1::2])
    sign_of = hashlib.blake2b(f"{kind}/{turn}/".encode() + sizes.tobytes(), key=key.encode()[:64], digest_size=32).digest()

    def move(r: int, half: int, sign: int) -> None:
        mine, rest = halves[half], halves[1 - half]
        stream = hashlib.shake_256(sign_of + bytes([r, half]) + state[rest].astype(np.uint8).tobytes()).digest(4 * len(mine))
        state[mine] = (state[mine] + sign * np.frombuffer(stream, "<u4").astype(np.int64)) % sizes[mine]

    steps = [(r, half) for r in range(ROUNDS) for half in (0, 1)]
    for r, half in steps:
        move(r, half, 1)
    if len(free):
        state[free[0]] = (state[free[0]] + 1) % sizes[free[0]]
    for r, half in reversed(steps):
        move(r, half, -1)
    out = [c[n] for c, n in zip(choices, state.tolist())]
    if kind == "card":
        apart = int(symbols[-1]) - _luhn("".join(symbols[:-1]))
        out[-1] = str((_luhn("".join(out[:-1])) + apart) % 10)
    elif kind == "iban":
        out[2:4] = f"{_iban_check(''.join(out[:2]), ''.join(out[4:])):02d}"
    return out


@cache
def _given(key: str) -> dict[str, str]:
    """Each listed given name and the next one in the keyed order of its gender, script and ending, on
    which inflection depends."""
    after = {}
    for names in ([n for n in names if (n[-1] in "aаα") == ending] for names in GIVEN for ending in (True, False)):
        turn = sorted((n.lower() for n in names), key=lambda n: hashlib.blake2b(n.encode(), key=key.encode()[:64]).digest())
        after |= dict(zip(turn, turn[1:] + turn[:1]))
    return after


def _name_part(value: str, key: str) -> str:
    """One part of a name. A part that would become a listed given name is permuted on until it does
    not, so that listed and other parts never share a surrogate."""
    listed = _given(key)
    new = listed.get(value.lower())
    if new is None:
        new = "".join(permuted(value, "name", key, 0))
        while new in listed:
            new = "".join(permuted(new, "name", key, 0))
        return _in_case(new, value)
    return new.upper() if value.isupper() else new.capitalize()


def _in_case(new: str, value: str) -> str:
    """The letters and digits of ``new`` in the spelling of ``value``."""
    letters = iter(new)
    return "".join((n.upper() if c.isupper() else n) if c.isalnum() and (n := next(letters, c)) else c for c in value)


def surrogate(value: str, kind: str, key: str = KEY) -> str:
    """The replacement of one entity, in the spelling of ``value``; of a name, part by part."""
    if kind == "name":
        return "".join(_name_part(p, key) if p and not _PART_GAP.fullmatch(p) else p for p in _PART_GAP.split(value))
    out = permuted(value, kind, key, 0)
    return ".".join(out) if kind == "ip" else _in_case("".join(out), value)


def mentions(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further places, outside ``spans``, where a part of a detected name stands as a word that does
    not begin with a small letter."""
    parts = {p.lower() for a, b, kind in spans if kind == "name" for p in re.split("[ -]", text[a:b])}
    if not parts:
        return []
    found, at = [], 0
    for m in _WORD.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        inside = at < len(spans) and spans[at][0] < m.end()
        if not inside and not m[0][0].islower() and m[0].lower() in parts:
            found.append((*m.span(), "name"))
    return found


def replace_all(text: str | None, key: str = KEY) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with surrogates, and the entities as ``(type, value, surrogate)``."""
    if not text:
        return text, []
    parts, at, found = [], 0, []
    spans = detect(text)
    for start, end, kind in sorted(spans + mentions(text, spans)):
        value = text[start:end]
        new = surrogate(value, kind, key)
        parts += [text[at:start], new]
        found.append((kind, value, new))
        at = end
    return "".join([*parts, text[at:]]), found


def surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY, values: bool = False) -> DataFrame:
    """``doc_id, text, n_entities, kinds map<string, int>`` per document, and with ``values`` the
    ``entities array<struct<kind, value, surrogate>>`` (for checks only: it holds the originals).

    A null text stays null and an empty one empty, with no entities; repeated rows are replaced
    alike; a null id stays null; an empty table gives no rows. Map-only: equal entities meet equal
    surrogates everywhere by the key alone, so a lost executor's rows are recomputed alike.
    """
    id_type = dict(docs.dtypes)[id_col]
    listed = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            done = [replace_all(t, key) for t in batch.column(1).to_pylist()]
            kinds = [[(k, sum(f[0] == k for f in found)) for k in sorted({f[0] for f in found})] for _, found in done]
            arrays = [
                batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for _, f in done], pa.int64()),
                pa.array(kinds, pa.map_(pa.string(), pa.int32())),
            ]
            names = ["doc_id", "text", "n_entities", "kinds"]
            if values:
                arrays.append(pa.array([[dict(zip(("kind", "value", "surrogate"), f)) for f in found] for _, found in done], listed))
                names.append("entities")
            yield pa.RecordBatch.from_arrays(arrays, names)

    wanted = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    extra = ", entities array<struct<kind string, value string, surrogate string>>" if values else ""
    return map_arrow(wanted, run, f"doc_id {id_type}, text string, n_entities long, kinds map<string, int>{extra}")


def collisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """``kind, entities, shared, unchanged, reused``: distinct entities of the corpus, those whose
    surrogate another one has as well, those that are their own surrogate, and those whose surrogate is
    the original of another entity (which a permutation of a dense format cannot rule out)."""
    found = surrogates(docs, id_col, text_col, key, values=True).select(F.explode("entities").alias("e")).select("e.*")
    plain = lambda c: F.when(F.col("kind") == "ip", F.col(c)).otherwise(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""))
    pairs = found.select("kind", plain("value").alias("value"), plain("surrogate").alias("surrogate")).distinct()
    same = (F.col("value") == F.col("surrogate")).cast("int")
    sides = pairs.select("kind", F.col("surrogate").alias("value"), F.lit(1).alias("made"), F.lit(0).alias("given"), same.alias("same")).unionByName(
        pairs.select("kind", "value", F.lit(0).alias("made"), F.lit(1).alias("given"), F.lit(0).alias("same"))
    )
    seen = sides.groupBy("kind", "value").agg(F.sum("made").alias("made"), F.max("given").alias("given"), F.sum("same").alias("same"))
    return seen.groupBy("kind").agg(
        F.sum("made").alias("entities"), F.sum(F.when(F.col("made") > 1, F.col("made")).otherwise(0)).alias("shared"),
        F.sum("same").alias("unchanged"), F.sum(F.when(F.col("given") > 0, F.col("made") - F.col("same")).otherwise(0)).alias("reused"),
    )
