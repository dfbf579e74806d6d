"""Quality rules: base counts of every text, and a likelihood ratio of hashed word n-grams.

Words and pairs of words are hashed into buckets. Two multinomials over the buckets are estimated:
one of all documents, one of all trusted documents. A text's score is the mean log-likelihood ratio
of its n-grams, and it is kept if the score reaches a fixed quantile of the trusted documents' scores
less a multiple of their spread below the median. Nothing is sampled. Texts are read where they lie,
and shuffled once to find those of trusted documents; beside them only bucket counts and scores move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voteframe.llm.common import map_arrow, slices
from voteframe.llm.words import Words, covered, mix
from voteframe.operators.ordering import exact_percentiles
from voteframe.operators.selection_by_radix import BITS
from voteframe.session import cut_lineage

BUCKETS = 1 << 14
WINDOW = 8
QUANTILE = 0.01
SPREADS = 1.0
SYMBOLS = "[#*$%&|<>]"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS[1:-1]]] = True
BLANKS = " \t\n\v\f\r"


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line of the text."""
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(BLANKS):
            again += line in seen
            seen.add(line)
    return again


def base_counts(texts: pa.Array, words: Words, window: int = WINDOW) -> dict[str, np.ndarray]:
    at, hashed = words.grams(window)
    if len(at):
        doc = words.doc[at]
        with np.errstate(over="ignore"):
            order = np.argsort(hashed ^ mix(doc.astype(np.uint64) + np.uint64(1)), kind="stable")
        h, d = hashed[order], doc[order]
        same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = at[twice]
    letters = ~words.space & ((words.raw & 0xC0) != 0x80)
    return {
        "n_words": np.diff(words.first),
        "word_chars": words.bytes_per_text(letters),
        "n_symbols": words.bytes_per_text(_SYMBOL[words.raw]),
        "n_dup_lines": np.array([repeated_lines(t) for t in texts.to_pylist()], np.int64),
        "n_repeat_words": words.per_text(covered(len(words.start), at, window)),
    }


def buckets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the texts they belong to."""
    at, pairs = words.grams(2)
    hashed = np.concatenate([words.hash, pairs])
    return (hashed % np.uint64(n)).astype(np.int64), np.concatenate([words.doc, words.doc[at]])


def mean_scores(words: Words, weights: np.ndarray) -> np.ndarray:
    """Mean weight of each text's n-grams; 0 for a text without words."""
    ids, doc = buckets(words, len(weights))
    n = len(words.off) - 1
    total = np.bincount(doc, weights[ids], n)
    return total / np.maximum(np.bincount(doc, minlength=n), 1)


def bucket_counts(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """Counts of n-grams per bucket over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n, np.int64)
        for batch in slices(batches, "text"):
            ids, _ = buckets(Words(batch.column(0)), n)
            counts += np.bincount(ids, minlength=n)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    parts = map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(raw_counts: DataFrame, target_counts: DataFrame, n: int, smoothing: float = 1.0) -> np.ndarray:
    """Log-likelihood ratio of trusted and raw text per bucket: ``n`` numbers, however large the
    corpus is."""
    raw, target = np.zeros(n), np.zeros(n)
    for counts, found in ((raw_counts, raw), (target_counts, target)):
        for row in counts.collect():
            found[row.bucket] = row.n
    part = lambda x: np.log((x + smoothing) / (x.sum() + smoothing * n))
    return part(target) - part(raw) if target.sum() else np.zeros(n)


def scores(docs: DataFrame, weights: np.ndarray, id_col: str, text_col: str, base: bool) -> DataFrame:
    key = dict(docs.dtypes)[id_col]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if base else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(1))
            found = base_counts(batch.column(1), words) if base else {}
            arrays = [batch.column(0), *[pa.array(found[c]) for c in counts], pa.array(mean_scores(words, weights))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *counts, "score"])

    rest = "".join(f"{c} long, " for c in counts)
    wanted = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return map_arrow(wanted, run, f"doc_id {key}, {rest}score double")


def threshold(trusted_scores: DataFrame, quantile: float, spreads: float) -> float:
    """The trusted scores' low quantile, less ``spreads`` times its distance from the median; keeps
    all where there are none. Exact, and no buffer holds the scores."""
    low, middle = exact_percentiles(trusted_scores, "score", [quantile, 0.5], few=1 << BITS).first()[0]
    return float("-inf") if low is None else low - spreads * (middle - low)


def quality(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    n_buckets: int = BUCKETS, quantile: float = QUANTILE, spreads: float = SPREADS,
) -> DataFrame:
    """One row per document: base counts, ``score`` (mean log-likelihood ratio), ``base_failed``,
    ``kept``.

    ``trusted`` holds the ids of trusted documents, all of which define the target and the threshold.
    All documents define the raw multinomial and all are scored.
    A null or empty text has no words and fails the base rule; with no trusted document every score
    is 0 and only the base rule decides; a null id is never trusted; repeated rows are scored alike.
    """
    ids = trusted.select(F.col(id_col).alias("__id")).where(F.col("__id").isNotNull()).distinct()
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    # The ids grow with the table, so they are dealt out and never broadcast.
    chosen = slim.join(ids.hint("shuffle_hash"), slim[id_col] == F.col("__id"), "left_semi")
    weights = log_ratios(bucket_counts(slim, "text", n_buckets), bucket_counts(chosen, "text", n_buckets), n_buckets)
    scored = cut_lineage(scores(slim, weights, id_col, "text", True), "scores")
    limit = threshold(scored.join(ids, scored["doc_id"] == F.col("__id"), "left_semi"), quantile, spreads)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= F.lit(limit)))
