"""The numbered operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voteframe.llm import fingerprints, langid, lexical, licenses, linededup, mixing, neardup, packing, pii, quality, substrings, toxicity, turns
from voteframe.llm.common import key_crc, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_join(table(spark, sf_dir, "documents"))


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, key_crc("doc_id") % 4 != 2)
    held_out = (key_crc("doc_id") % 4 == 2).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn_profiles(docs, key_crc("doc_id") % 5 != 0)
    held_out = (key_crc("doc_id") % 5 == 0).alias("held_out")
    return langid.identify(docs, profiles).select("doc_id", held_out, "lang_pred", "score")


#: Shares of tokens that the mixing query and the pipeline ask for, by language.
TARGETS = {"en": 0.55, "de": 0.17, "fr": 0.16, "es": 0.12}


def labelled_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The labelled rows' ids with their language as the domain."""
    rows = table(spark, sf_dir, "labels").select("doc_id")
    return docs.select("doc_id", F.col("lang").alias("domain")).join(rows, "doc_id", "left_semi")


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed, domains = mixing.mix(docs, labelled_domains(spark, docs, sf_dir), TARGETS)
    shares = [(F.col("__parts")[i] / mixing.PARTS).alias(f"p_{d}") for i, d in enumerate(domains)]
    return mixed.select(
        "doc_id", F.col("__tokens").alias("tokens"), *shares, F.round("__rate", 6).alias("rate"), F.col("__copies").alias("copies")
    )


@query("op6_line_dedup", linededup.LINE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs)
    return out.select(
        "doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__dropped").cast("long").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.quality(table(spark, sf_dir, "documents"), trusted)


@query("op8_surrogates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.surrogates(table(spark, sf_dir, "documents"))
    kinds = [F.coalesce(F.col("kinds")[k], F.lit(0)).alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", "n_entities", *kinds, "text")


@query("op9_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


#: The windows of every document, and whether a smaller document has the same one.
REPEAT_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
starts as (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w),
win as (select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as h from starts),
least as (select h, min(doc_id) as low from win group by h),
hit as (select doc_id, list(i order by i) as places from win join least using (h) where doc_id > low group by doc_id),
gone as (select doc_id, list(distinct p) as p from (select doc_id, unnest(range(s, s + 50)) as p from (select doc_id, unnest(places) as s from hit)) group by doc_id),
kept as (select w.doc_id, len(words) as n_words, coalesce(len(p), 0) as n_removed,
    case when p is null then words else list_transform(list_filter(range(1, len(words) + 1), lambda j: not list_contains(p, j)), lambda j: words[j]) end as k
  from w left join gone on w.doc_id = gone.doc_id)
select doc_id, n_words::bigint as n_words, n_removed::bigint as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""


@query("op10_substring_dedup", REPEAT_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_search", lexical.SEARCH_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_licenses", licenses.LICENSE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


@query("op13_prefix_trie", turns.TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.prefix_trie(table(spark, sf_dir, "conversations"))
