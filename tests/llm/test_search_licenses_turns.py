"""Lexical search, license scans and the prefix trie against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from voteframe.llm import lexical, licenses, turns
from voteframe.llm.license_rules import Rule, all_rules

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, top):
    """All documents against all items, one by one."""
    bags = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    holding = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
                for t in set(TERM.findall((text or "").translate(FOLD))) if bag[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def random_text(rng, words, n):
    return rng.choice([" ", "-", "\n", "; "]).join(rng.choice(words) for _ in range(n))


@pytest.mark.parametrize("top", [3, 50])
def test_search_is_that_of_every_document(spark, top):
    rng = random.Random(top)
    words = ["Alpha", "alpha", "beta", "gámma", "GÁMMA", "d3lta", "eta_x", "zeta", "日本", "iota", "k"] + [f"w{i}" for i in range(30)]
    copies = [random_text(rng, words, 12) for _ in range(4)]
    docs = [(i, rng.choice(copies) if rng.random() < 0.7 else random_text(rng, words, rng.randrange(40))) for i in range(150)]
    docs += [(None, copies[0]), (-5, copies[1]), (1000, None), (1001, ""), (1002, "!!! --"), (1003, "w1 " * 5000)]
    items = [(i, random_text(rng, words, rng.randrange(1, 15))) for i in range(12)] + [(90, None), (91, ""), (92, "unknownword"), (93, "??")]
    found = lexical.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({"key": F.lit(1), "item_id": F.lit(2)}),
        spark.createDataFrame(items, "item_id long, text string"), top=top,
    )
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=str) == plain_search(docs, items, top)


def test_search_in_blocks_and_parts(spark, monkeypatch):
    """Several blocks of items, few cells at once and texts cut into small parts give the same rows."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, random_text(rng, words, rng.randrange(1, 60))) for i in range(60)]
    items = [(i, random_text(rng, words, 6)) for i in range(7)]
    for name, value in (("BLOCK_ITEMS", 3), ("CHUNK", 16), ("CELLS", 20)):
        monkeypatch.setattr(lexical, name, value)
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), top=5)
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=str) == plain_search(docs, items, 5)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(docs, items).count() == 1


def test_best_keeps_the_smallest_ids_of_equal_scores():
    import numpy as np

    best = lexical.Best(2, 3)
    for first in (9, 4, 7, 1, 8, 3):
        best.add(np.array([[5, 0]]), *(np.array([x]) for x in (first, first, 50, 1)))
        best.prune()
    assert best.rows[:, 2].tolist() == [1, 3, 4] and set(best.rows[:, 0]) == {0}


def plain_scan(text, phrases, rules):
    """Every rule at every word, without keywords, and every pair of matches."""
    words = TERM.findall((text or "").translate(FOLD))
    found = []
    for label, phrase in phrases.items():
        want = phrase.split(" ")
        found += [(i, i + len(want), 0, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    base = list(found)
    seen = list(base)
    for at, rule in enumerate(rules):
        i = 0
        while i < len(words):
            rest = " ".join(words[i:]) + " "
            m = re.match(f"(?:{rule.pattern}) ", rest)
            if m:
                n = m.group(0).count(" ")
                seen.append((i, i + n, rule.priority, rule.label, at))
                i += n
            else:
                i += 1
    kept = [a for a in seen if a[2] == 0 or not any(
        b[0] <= a[0] and b[1] >= a[1] and (b[2] < a[2] or b[2] == a[2] and (b[1] - b[0] > a[1] - a[0] or b[:2] == a[:2] and b[4] < a[4]))
        for b in seen if b is not a)]
    starts = [b[0] for b in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b[3] for b in base})),
        ",".join(sorted({k[3] for k in kept})), sorted((k[0], k[1], k[3], k[2]) for k in kept),
    )


TEXTS = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0; see apache.org/licenses/LICENSE-2.0",
    "This work is licensed under the GNU General Public License, version 3.", "CC BY-NC 4.0 and cc-by-nc-sa 4.0, cc by nc cc by nc",
    "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: MIT", "under mit", "licensed under MIT now",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and", "the lesser general public license",
    "GNU Lesser General Public License version 2.1 or the GNU Affero General Public Licence v3", "ALL RIGHTS RESERVED\n" * 40,
    "creative commons attribution non commercial share alike 4.0", "creative commons attribution noncommercial", "nothing at all", None, "", " ;; ",
    "12:under the mit license", "apache license version 2 apache license version 2 0", "lıcense under the mit lİcense", "Kelvin cc by nc",
    "bsd 3 clause license or the 2-clause BSD licence", "x " * 30_000 + "under the mit license",
]


@pytest.fixture(scope="module")
def scanned(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (3, TEXTS[3])], "doc_id long, text string")
    return licenses.scan(docs.withColumns({"row": F.lit(1), "found": F.lit("x"), "start": F.lit(0)}).repartition(4)).collect()


def test_licenses_are_those_of_all_rules(scanned):
    rules = all_rules()
    assert len(scanned) == len(TEXTS) + 2 and sum(r.doc_id == 3 for r in scanned) == 2
    for r in scanned:
        text = TEXTS[r.doc_id] if r.doc_id is not None else TEXTS[0]
        if text and len(text) > 50_000:
            assert (r.n_words, r.n_base, r.first_word, r.labels) == (30_004, 1, 30_000, "mit")
            continue
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, sorted((s["start"], s["end"], s["label"], s["priority"]) for s in r.spans))
        assert got == plain_scan(text, licenses.PHRASES, rules), text


def test_labels_of_usual_notices(scanned):
    labels = {r.doc_id: r.labels for r in scanned}
    assert [labels[i] for i in (0, 1, 2, 4, 5, 6, 7, 8, 9, 10)] == ["mit", "apache-2", "gpl-3", "gpl-3", "mit", "", "mit", "mit", "lgpl", "agpl-3,lgpl-2.1"]
    assert labels[12] == "cc-by-nc-sa" and labels[13] == "cc-by-nc" and labels[22] == "bsd-2,bsd-3" and labels[14] == ""
    assert {r.score for r in scanned if r.doc_id in (14, 15, 16)} == {0.0}


def test_rules_are_tried_in_order_and_places_may_overlap(spark):
    docs = spark.createDataFrame([(1, "a b a b a"), (2, "x a b c d")], "doc_id long, text string")
    rules = [Rule("long", " b c ", "a b c", 2, 0.5), Rule("short", " c ", "c", 1, 0.6), Rule("inner", " b ", "b", 3, 0.4), Rule("again", " c ", "c", 1, 0.7)]
    rows = {r.doc_id: r for r in licenses.scan(docs, phrases={"self": "a b a"}, rules=rules).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word) == (2, 0, 2) and rows[1].labels == "self"
    assert rows[2].labels == "long,short" and rows[2].score == 0.6


def test_every_match_holds_its_keyword(spark):
    """A rule's keyword stands in all that the rule can match."""
    for rule in all_rules():
        shortest = rule.pattern
        while "(?:" in shortest:  # innermost groups: none where optional, else each alternative
            shortest = re.sub(r"\(\?:([^()]*)\)\?", "", shortest, count=1) if re.search(r"\(\?:[^()]*\)\?", shortest) else re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", shortest, count=1)
        for text in shortest.split("|"):
            text = re.sub(r"\[(.)[^\]]*\]\*?", r"\1", text).replace("s?", "s")
            assert re.fullmatch(rule.pattern, text), (rule.pattern, text)
            assert rule.keyword in f" {text} ", (rule.keyword, text)


def plain_trie(rows, family=20, heads=4):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            known = f"{len(role or '')}:{role or ''}{text or ''}"
            key = (turn is not None, turn or 0, role or "", hashlib.sha256(known.encode()).digest()[:16])
            by[c].append((key, role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(v)] for c, v in by.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        made[c] = convs.get(c - int(math.fmod(c, family)), [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    below = defaultdict(lambda: [0, 0])
    children = Counter(p[:-1] for p in nodes if p)
    for p, members in nodes.items():
        own = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += not children[p]
            below[p[:d]][1] += own
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children[p], *below[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)).encode()).hexdigest())
        for p, m in nodes.items()
    )


def conversation_rows(seed=0):
    rng = random.Random(seed)
    said = [("user", "hi there"), ("user", "a\tb  c\n"), ("assistant", None), (None, "x y z"), ("system", ""), ("user", "ünï cödé")]
    rows = []
    for c in [*range(60), 1001, 5000, 5020, 9000, 9007, -3, -20, -41]:
        rows += [(c, t, *rng.choice(said[:2])) for t in range(rng.randrange(1, 6))]
    deep = [rng.choice(said) for _ in range(45)]
    for c, n in ((2000, 45), (2001, 45), (2002, 31), (2003, 17), (2040, 45), (2041, 40)):
        rows += [(c, t, *deep[t]) for t in range(n)]
    rows += [(2004, t, *(deep[t] if t != 20 else ("user", "else"))) for t in range(40)]
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (7, 2, "user", "tie"), (7, 2, "assistant", "tie"), (None, 1, "user", "no one")]
    rows += [(3000 + i, 0, "user", "same") for i in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, hot", [(8, 10**6), (3, 10**6), (2, 4)])
def test_trie_is_that_of_all_prefixes(spark, monkeypatch, width, hot):
    rows = conversation_rows(width)
    monkeypatch.setattr(turns, "RANGE", 16)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"at": F.lit(1), "block": F.lit(2)})
    got = turns.prefix_trie(table.repartition(3), width=width, hot_rows=hot).collect()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(-1 if n == "parent_conv_id" and r[n] is None else r[n] for n in names) for r in got) == plain_trie(rows)


def test_trie_of_turnless_conversations_and_of_none(spark):
    kind = "conv_id long, turn long, role string, text string"
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 2)
    rows = turns.prefix_trie(spark.createDataFrame([(lone, 0, "user", "one two")], kind)).collect()
    assert len(rows) == 1 and (rows[0].depth, rows[0].n_convs, rows[0].n_leaves, rows[0].parent_conv_id) == (0, 1, 1, None)
    assert rows[0].ends_sha256 == hashlib.sha256(str(lone).encode()).hexdigest()
    assert turns.prefix_trie(spark.createDataFrame([], kind)).count() == 0
    assert turns.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], kind)).count() == 0
