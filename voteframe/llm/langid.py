"""Language identification by rank-order profiles.

A language's profile is the ranked list of its most frequent character n-grams (one to three
characters of words, with the word's edges). A text's own ranked list is compared with each profile
by the out-of-place distance: the sum of the differences of ranks, and a fixed penalty for an n-gram
that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voteframe.llm.common import among_smallest, key_hash, map_arrow, slices

PROFILE = 400
PER_LANGUAGE = 2_000
LANGUAGES = 200
NO_LANGUAGE = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_codes(text: str | None) -> np.ndarray:
    """Codes of all n-grams of one to three characters; everything but letters is a word's edge."""
    chars = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    chars = np.where(letters()[chars], chars, 0)
    padded = np.concatenate([[0], chars, [0]])
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    s = padded[keep]
    if len(s) < 3:
        return np.zeros(0, np.int64)
    pairs = (s[:-1] << 21) | s[1:]
    return np.concatenate([s[s > 0], pairs, (pairs[:-1] << 21) | s[2:]])


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, equal ones by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


@dataclass
class Profiles:
    """Ranks of the n-grams of all profiles; ``size`` where a language lacks one."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def build(cls, lists: dict[str, np.ndarray], size: int) -> "Profiles":
        names = sorted(lists)
        codes = np.unique(np.concatenate([*lists.values(), np.zeros(0, np.int64)])).astype(np.int64)
        ranks = np.full((len(codes), len(names)), size, np.int32)
        for j, name in enumerate(names):
            ranks[np.searchsorted(codes, lists[name]), j] = np.arange(len(lists[name]))
        return cls(names, codes, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language at the least distance (the first by name of equal ones) and its margin over
        the next one: 0.5 is a tie, 1 a perfect match."""
        grams = gram_codes(text)
        if not len(grams) or not self.languages:
            return NO_LANGUAGE, 0.0
        codes, counts = np.unique(grams, return_counts=True)
        top = ranked(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        known = self.codes[at] == top
        places = np.arange(len(top))[:, None]
        apart = np.where(known[:, None], np.abs(self.ranks[at] - places), self.size)
        lacking = known[:, None] & (self.ranks[at] == self.size)
        apart[lacking] = self.size
        distance = apart.sum(0) / (len(top) * self.size)
        best = int(np.argmin(distance))
        if len(distance) == 1:
            return self.languages[0], float(1 - min(distance[0], 1))
        second = np.delete(distance, best).min()
        both = distance[best] + second
        return self.languages[best], float(second / both) if both > 0 else 0.5


def learn_profiles(
    docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    size: int = PROFILE, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES,
) -> Profiles:
    """Profiles of at most ``per_language`` texts of each language (those with the smallest key
    hashes). More than ``languages`` labels are an error: what the driver and every task hold grows
    with them, and none is left out without a word."""
    labelled = docs.where(use & F.col(lang_col).isNotNull())
    slim = labelled.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"))
    common = slim.groupBy("__lang").count()
    if common.limit(languages + 1).count() > languages:
        raise ValueError(f"more than {languages} languages; pass a larger bound as languages=")
    order = Window.partitionBy("__lang").orderBy(key_hash("__id"), "__id")
    picked = (
        slim.join(F.broadcast(common), "__lang").where(among_smallest("__id", F.col("count"), per_language))
        .withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_language)
        .select("__id").distinct()
    )
    # At most languages * per_language ids.
    texts = labelled.join(F.broadcast(picked), F.col(id_col) == F.col("__id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(gram_codes(text))
            for lang, parts in by.items():
                codes, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"]
                )

    columns = F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    counted = map_arrow(texts.select(*columns), run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).select("lang", "code", "rank")
    lists: dict[str, list[tuple[int, int]]] = {}
    for lang, code, rank in rows.collect():  # size entries for each of at most `languages` profiles
        lists.setdefault(lang, []).append((rank, code))
    return Profiles.build({k: np.array([c for _, c in sorted(v)], np.int64) for k, v in lists.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for the whole text of every document.

    A null text, one without letters, or no profiles at all: ``und`` with score 0. Ties go to the
    first language by name. Repeated rows are answered alike; a null id stays null. Map-only.
    """
    key = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    wanted = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return map_arrow(wanted, run, f"doc_id {key}, lang_pred string, score double")
