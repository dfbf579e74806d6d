"""License scans by ordered signature rules.

The rules of ``license_rules`` are regular expressions over words. A text is brought to words once; a
document that holds none of the rules' keywords is done, the others are written as ``0:first 1:second ...``,
so that a match carries the places of its words, and only the rules whose keyword occurs are tried.
A match that lies within a match of a rule of higher priority, or of the same priority and more
words, is suppressed: a running maximum of ends in order of starts, per priority.

Everything is DataFrame functions. Texts are never shuffled; of documents with several matches these
matches are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from voteframe.llm.license_rules import Rule, all_rules
from voteframe.session import cut_lineage

#: Phrases that always count: label and words.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def placed_pattern(words: str) -> str:
    """The pattern of a rule over words with their places."""
    return r"\d+:(?:" + words.replace(" ", r" \d+:") + ") "


def phrase_pattern(words: str) -> str:
    """A phrase; only its first word is consumed, so that places may overlap."""
    first, *rest = words.split(" ")
    return rf"\d+:{first} " + (f"(?={''.join(rf'\d+:{w} ' for w in rest)})" if rest else "")


def rule_rows(phrases: dict[str, str], rules: list[Rule]) -> list[dict]:
    """Phrases come first, with priority 0; ``words`` is set for rules that match their first word only."""
    rows = [
        {"keyword": f" {words} ", "pattern": phrase_pattern(words), "label": label, "priority": 0, "score": 1.0, "words": len(words.split(" "))}
        for label, words in phrases.items()
    ]
    rows += [
        {"keyword": r.keyword, "pattern": placed_pattern(r.pattern), "label": r.label, "priority": r.priority, "score": r.score, "words": None}
        for r in rules
    ]
    return [{"id": i} | row for i, row in enumerate(rows)]


def constant(rows: list, kind: str) -> Column:
    """An array that is a constant of the plan."""
    return F.from_json(F.lit(json.dumps(rows)), kind)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def spaced(text: Column) -> Column:
    """The words, whatever their case, with one blank before and after each; a blank for none."""
    words = F.btrim(F.regexp_replace(text, _SEPARATORS, " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def count_words(spaced_text: Column) -> Column:
    gaps = F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit("")))
    return F.when(F.length(spaced_text) > 2, gaps - 1).otherwise(F.lit(0)).cast("long")


def matches(spaced_text: Column, rules: Column) -> Column:
    """``array<struct<start, end, rule>>``: the places of all matches of the rules."""
    words = F.split(F.btrim(F.translate(spaced_text, _UPPER, _LOWER)), " ")
    placed = F.concat_ws("", F.transform(words, lambda w, i: F.concat(i.cast("string"), F.lit(":"), w, F.lit(" "))))

    def one(rule: Column, text: Column) -> Column:
        found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
        number = lambda word: F.substring_index(word, ":", 1).cast("long")
        last = lambda m: number(F.substring_index(F.rtrim(m), " ", -1)) + 1
        return F.transform(found, lambda m: F.struct(
            number(m).alias("start"), F.coalesce(number(m) + rule["words"], last(m)).alias("end"), rule["id"].alias("rule")
        ))

    return bound(placed, lambda text: F.flatten(F.transform(rules, lambda rule: one(rule, text))))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
    rules: list[Rule] | None = None,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` per document.

    ``n_base`` counts the places of ``phrases`` (label: words of a-z and digits), ``first_word`` and
    ``last_word`` are their smallest and largest first words (null: none). ``labels`` are those of the
    phrases and of all rules' matches that are not suppressed, ``spans array<struct<start, end, label,
    priority>>`` these matches in order of place, ``score`` the highest score among them, 0 for none.

    Null and empty texts have no words. Repeated rows give repeated rows, null ids stay. An empty
    table gives no rows. Other columns are not read.
    """
    rows = rule_rows(PHRASES if phrases is None else phrases, all_rules() if rules is None else rules)
    n_base = sum(r["priority"] == 0 for r in rows)
    table = constant(rows, "array<struct<id:int,keyword:string,pattern:string,label:string,priority:int,score:double,words:int>>")
    keywords = constant(sorted({r["keyword"] for r in rows}), "array<string>")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    gated = bound(spaced(text), lambda words: bound(
        bound(F.lower(words), lambda low: F.filter(keywords, lambda k: F.contains(low, k))),
        lambda held: F.struct(
            count_words(words).alias("n_words"),
            F.when(F.size(held) > 0, matches(words, F.filter(table, lambda r: F.array_contains(held, r["keyword"])))).alias("found"),
        ),
    ))
    found = docs.select(F.col(id_col).alias("doc_id"), gated.alias("__g")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("__g.n_words").alias("n_words"),
        F.array_sort(F.coalesce("__g.found", F.array().cast("array<struct<start:long,end:long,rule:int>>"))).alias("found"),
    )
    # The row numbers are those of the written table, the same whenever it is read.
    found = cut_lineage(found, "matches")
    base = F.filter("found", lambda m: m["rule"] < n_base)
    starts = F.transform(base, lambda m: m["start"])
    figures = [
        "row", "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(F.transform(base, lambda m: table[m["rule"]]["label"])).alias("base_labels"),
    ]
    one = lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), table[m["rule"]]["label"].alias("label"),
        table[m["rule"]]["priority"].alias("priority"), table[m["rule"]]["score"].alias("score"))
    quiet = found.where("size(found) < 2").select(*figures, F.transform("found", one).alias("spans"))
    busy = found.where("size(found) > 1")
    several = busy.select("row", F.inline("found")).withColumn("m", one(F.struct("start", "end", "rule")))
    before = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "m.priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r["priority"] for r in rows})
    reach = F.coalesce(*[F.when(F.col("m.priority") == p, F.max(F.when(F.col("m.priority") <= p, F.col("end"))).over(before)) for p in levels])
    kept = several.withColumn("reach", reach).where("m.priority = 0 or reach is null or reach < end")
    # A document's matches are no more than its words allow.
    kept = kept.groupBy("row").agg(F.array_sort(F.collect_list("m")).alias("spans"))
    out = busy.select(*figures).join(kept, "row").unionByName(quiet)
    labels = joined(F.transform("spans", lambda m: m["label"]))
    score = F.coalesce(F.array_max(F.transform("spans", lambda m: m["score"])), F.lit(0.0))
    spans = F.transform("spans", lambda m: m.dropFields("score"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"), spans.alias("spans")
    )


def joined(labels: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.array_distinct(labels)))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values() -> str:
    """The rules for another engine, whose regular expressions know no lookahead: the phrases there
    are matched whole, which gives the same places for phrases that cannot overlap themselves."""
    rows = []
    for r in rule_rows(PHRASES, all_rules()):
        pattern = placed_pattern(PHRASES[r["label"]]) if r["priority"] == 0 else r["pattern"]
        rows.append(f"({r['id']}, {_quoted(r['keyword'])}, {_quoted(pattern)}, {_quoted(r['label'])}, {r['priority']}, {r['score']})")
    return ",\n".join(rows)


LICENSE_SQL = rf"""
with rules(id, keyword, pattern, label, priority, score) as (values
{_values()}),
parsed as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
placed as (select doc_id, len(words) as n_words, ' ' || array_to_string(words, ' ') || ' ' as plain, words from parsed),
hits as (select doc_id, r.*, words from placed join rules r on contains(plain, r.keyword)),
found as (select doc_id, id, label, priority, score, unnest(regexp_extract_all(
    array_to_string(list_transform(words, lambda w, i: (i - 1)::varchar || ':' || w || ' '), ''), pattern)) as m from hits),
spans as (select doc_id, id, label, priority, score, split_part(m, ':', 1)::bigint as lo,
    split_part(split_part(rtrim(m), ' ', -1), ':', 1)::bigint + 1 as hi from found),
kept as (select * from spans a where priority = 0 or not exists (select 1 from spans b where b.doc_id = a.doc_id and b.lo <= a.lo and b.hi >= a.hi
    and (b.priority < a.priority or b.priority = a.priority and (b.hi - b.lo > a.hi - a.lo or b.hi - b.lo = a.hi - a.lo and b.id < a.id)))),
listed as (select doc_id, count(*) filter (where priority = 0) as n_base, min(lo) filter (where priority = 0) as first_word,
    max(lo) filter (where priority = 0) as last_word, string_agg(distinct label, ',' order by label) filter (where priority = 0) as base_labels,
    string_agg(distinct label, ',' order by label) as labels, max(score)::double as score from kept group by doc_id)
select doc_id, n_words::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from placed left join listed using (doc_id)
"""
