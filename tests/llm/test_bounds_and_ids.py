"""Chosen stems against plain Python, ids of any type, and bounds that are errors and never cuts."""

import random

import pytest
from pyspark.sql import functions as F

from voteframe.llm import langid, mixing, toxicity


def stems_in_python(support, size):
    """Stems that no longer one replaces, the shorter of two that begin alike, the most frequent."""
    closed = {
        s for s, n in support.items()
        if not any(t[:-1] == s and m * 20 >= n * 19 for t, m in support.items())
    }
    best = [s for s in closed if not any(s[:k] in closed for k in range(1, len(s)))]
    return sorted(sorted(best, key=lambda s: (-support[s], s))[:size])


@pytest.mark.parametrize("size", [1, 7, 400])
def test_stems_are_chosen_among_all_candidates(spark, size):
    rng = random.Random(5)
    support = {}
    for _ in range(300):
        word, n = "".join(rng.choices("abé", k=rng.randint(5, 12))), rng.choice([30, 40, 41, 60])
        for k in range(4, len(word) + 1):
            support[word[:k]] = max(support.get(word[:k], 0), n + (12 - k) * rng.choice([0, 0, 3]))
    counts = spark.createDataFrame([(s, n, 0) for s, n in support.items()] + [("often", 90, 900), ("rare", 1, 0)], "stem string, toxic long, clean long")
    assert toxicity.choose_stems(counts, 100, 1000, size) == stems_in_python(support, size)


def test_ids_of_any_type_and_a_clashing_column(spark):
    rows = [(i, f"you are a blotzig number {i} of many" if i % 3 == 0 else f"a calm text number {i} about trees", int(i % 3 == 0)) for i in range(120)]
    numbers = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts = numbers.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    scores = []
    for docs in (numbers, texts):
        model = toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"), F.lit(True))
        assert any(s.startswith("blot") for s in model.stems)
        found = toxicity.score(docs, model).collect()
        scores.append({str(r.doc_id).removeprefix("doc-"): (r.score, r.predicted) for r in found})
    assert scores[0] == scores[1] and {p for _, p in scores[0].values()} == {0, 1}
    again = toxicity.score(texts.withColumn("__toxic_score", F.lit("old")), model, keep_columns=True)
    assert again.columns.count("__toxic_score") == 1
    assert {r.doc_id: r["__toxic_score"] for r in again.collect()} == {f"doc-{k}": v[0] for k, v in scores[1].items()}


def test_more_labels_than_the_bound_are_an_error(spark):
    docs = spark.createDataFrame([(i, f"words of language {i}", f"l{i}") for i in range(6)], "doc_id long, text string, lang string")
    assert len(langid.learn_profiles(docs, F.lit(True), languages=6).languages) == 6
    with pytest.raises(ValueError, match="languages"):
        langid.learn_profiles(docs, F.lit(True), languages=5)
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    assert len(mixing.fit_classifier(docs, labelled, domains=6).domains) == 6
    with pytest.raises(ValueError, match="domains"):
        mixing.fit_classifier(docs, labelled, domains=5)
