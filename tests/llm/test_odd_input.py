"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from voteframe.llm import fingerprints, langid, linededup, mixing, neardup, packing, pii, quality, substrings, toxicity

WORDS = "the quick brown fox jumps over the lazy dog and runs far away from all of them today".split()
LONG = " ".join(WORDS[i * 7 % 17] + str(i % 911) for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, part long, rep long, leaf string, keys string, trusted boolean, label int"
ROWS = [
    (None, None, None), (None, "a null id\nwith two lines of text", "en"), (1, "", "en"), (2, None, "en"), (3, "two words", "en"),
    (4, LONG, "en"), (5, LONG, "de"), (5, LONG, "de"), (6, "!!! 123 ???", None), (7, " \n\t \n ", "en"), (8, "idiot " * 30, "en"),
    (9, "x" * 200_000, "en"), (10, "\U0001f600 日本語 \u0000 end", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, g, 1, 2, "leaf", "k", True, 0) for i, t, g in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i == 8)) for i in range(1, 11)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


TARGETS = {"en": 0.5, "de": 0.5}
OPERATORS = {
    "jaccard": lambda d, l: neardup.jaccard_join(d),
    "pack": lambda d, l: packing.pack(d),
    "toxicity": lambda d, l: toxicity.score(d, toxicity.learn(d, l, F.lit(True))),
    "language": lambda d, l: langid.identify(d, langid.learn_profiles(d, F.lit(True))),
    "mixing": lambda d, l: mixing.mix(d, d.select("doc_id", F.col("lang").alias("domain")), TARGETS)[0],
    "lines": lambda d, l: linededup.dedup_lines(d),
    "quality": lambda d, l: quality.quality(d, l.select("doc_id")),
    "surrogates": lambda d, l: pii.surrogates(d),
    "fingerprints": lambda d, l: fingerprints.fingerprints(d),
    "edits": lambda d, l: fingerprints.compare_with_edits(d),
    "substrings": lambda d, l: substrings.remove_repeats(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(odd, labels, name):
    rows = OPERATORS[name](odd, labels).select("doc_id").collect()
    ids = sorted((r.doc_id for r in rows), key=lambda i: (i is None, i or 0))
    want = sorted((r[0] for r in ROWS), key=lambda i: (i is None, i or 0))
    assert (sorted(set(ids), key=str) == sorted(set(want), key=str)) if name == "pack" else ids == want


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(odd, labels, name):
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_defined_results(odd, labels):
    links = {r.doc_id: r for r in neardup.jaccard_join(odd.where("doc_id is not null")).collect()}
    assert links[5].n_links == 2 and links[5].group_id == 4 and links[4].n_links == 2
    assert links[1].group_id == links[2].group_id == links[7].group_id == 1 and links[3].n_links == 0
    kept = [r.doc_id for r in neardup.keep_one(odd).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 3, 4, 6, 8, 9, 10] and kept.count(None) == 2
    langs = {r.doc_id: r.lang_pred for r in OPERATORS["language"](odd, labels).collect()}
    assert langs[6] == langs[1] == langs[2] == "und"
    words = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(odd).collect()}
    assert words[4] == (60_000, 0) and words[5] == (60_000, 60_000) and words[9] == (1, 0)
    prints = {r.doc_id: r for r in fingerprints.fingerprints(odd).collect()}
    assert prints[1].fingerprint == prints[2].fingerprint == "" and prints[4].fingerprint == prints[5].fingerprint


def test_later_mentions_of_a_name_are_replaced():
    text = "Mr John Smith met Anna. Smith said so; JOHN left, john-of-all did not. Mr Smith, Dr Ana Maria Lopez Vega (Vega)."
    new, found = pii.replace_all(text)
    smith, john = pii.surrogate("Smith", "name"), pii.surrogate("John", "name")
    assert smith != "Smith" and new.startswith(f"Mr {john} {smith} met Anna. {smith} said so; {john.upper()} left, john-of-all did not. Mr {smith}, Dr ")
    vega = pii.surrogate("Vega", "name")
    assert new.endswith(f" {vega} ({vega}).") and "Vega" not in new and "Lopez" not in new and len(found) == 6


def test_short_values_have_surrogates_of_their_own():
    names = [f"{a}{b}n".capitalize() for a in "bcdfghjklmnpqrstvwxyz" for b in "aeiou"]
    assert len({pii.surrogate(n, "name") for n in names}) == len(names)
    assert not any(pii.surrogate(n, "name") == n for n in names)
    hosts = [f"{a}.{b}.1.1" for a in range(10) for b in range(10)]
    made = [pii.surrogate(f"{h}", "ip") for h in hosts]
    assert len(set(made)) == len(hosts) and not any(a == b for a, b in zip(hosts, made))


@pytest.fixture(scope="module")
def folder(labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_drops_recurring_short_lines(spark):
    import corpus_pipeline

    rows = [(i, f"own line {chr(97 + i)} of text\nAll rights reserved.\nLes.", 0) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    left = {r.doc_id: r.text for r in corpus_pipeline.fewer_lines(spark, docs, "").collect()}
    assert left[0] == rows[0][1] and all("rights" not in left[i] and "Les." not in left[i] for i in range(1, 6))


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, folder, stage):
    import corpus_pipeline

    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    name, function = corpus_pipeline.STAGES[stage]
    out = function(spark, docs, folder)
    rows = out.collect()
    assert rows and function(spark, docs.limit(0), folder).count() == 0
    if name != "packing":
        assert out.columns == docs.columns
        assert {r.doc_id for r in rows} <= {r[0] for r in ROWS}
    if name == "line_dedup":
        assert len(rows) == len(ROWS) and sum(r.text is None for r in rows) == 2
    if name == "jaccard_join":
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 4, 6, 8, 9, 10]
