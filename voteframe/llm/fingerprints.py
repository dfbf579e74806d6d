"""Document fingerprints by winnowing.

Hashes of all runs of k characters roll over the text; of every w neighbouring hashes the smallest
is chosen, the rightmost of equal ones. Two texts that share a run of w + k - 1 characters share a
chosen hash; positions are kept, so that the shared place can be found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voteframe.llm.common import map_arrow, slices
from voteframe.llm.words import mix, range_hashes

#: Two texts that share a run of ``K + W - 1`` = 19 characters share a chosen hash.
K, W = 16, 4
#: Characters of a text that are hashed at once, and bytes of all texts of a slice of rows.
PIECE, SLICE = 500_000, 500_000
#: Rows in the sample that places the bounds of a range, for each range.
SAMPLED = 50
#: Bytes of text in a range, as a task sorts it, and bytes that any row adds to its text.
RANGE, ROW = 32_000_000, 64
_BASE = 0x9E3779B97F4A7C15
U = np.uint64


def window_minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest of each ``w`` neighbours, the rightmost of equal ones."""
    value, at, width = hashes, np.arange(len(hashes)), 1

    def joined(shift: int) -> tuple[np.ndarray, np.ndarray]:
        right = value[shift:] <= value[:-shift]
        return np.where(right, value[shift:], value[:-shift]), np.where(right, at[shift:], at[:-shift])

    while 2 * width <= w:
        value, at = joined(width)
        width *= 2
    if width < w:
        value, at = joined(w - width)
    return at


def winnow(texts: list[str], k: int = K, w: int = W) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chosen hashes and their character positions for each text, in order of position.

    A text shorter than ``k`` is one run; an empty text has none; with fewer than ``w`` runs the
    smallest of all is chosen. A long text is worked on in pieces that overlap by a window, so
    that each window lies in one of them.
    """
    if all(len(t) <= PIECE for t in texts):
        return winnow_together(texts, k, w)
    out = []
    for text in texts:
        parts = []
        for at in range(0, max(len(text), 1), PIECE):
            piece = text[at : at + PIECE + k + w - 2]
            if at and len(piece) < k + w - 1:
                break  # the window at its beginning ended the piece before
            [(hashes, places)] = winnow_together([piece], k, w)
            parts.append((hashes, places + at))
        places, first = np.unique(np.concatenate([p for _, p in parts]), return_index=True)
        out.append((np.concatenate([h for h, _ in parts])[first], places))
    return out


def winnow_together(texts: list[str], k: int, w: int) -> list[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(t) for t in texts], np.int64)
    off = np.concatenate([[0], np.cumsum(sizes)])
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    run = np.minimum(sizes, k)
    count = np.where(sizes > 0, np.maximum(sizes - k + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(texts)), count)
    start = np.arange(first[-1]) - first[:-1][doc] + off[:-1][doc]
    hashes = mix(range_hashes(chars.astype(U) + U(1), start, start + run[doc], _BASE)) if len(start) else np.zeros(0, U)
    chosen = np.zeros(len(hashes), bool)
    if len(hashes) >= w:
        places = window_minima(hashes, w)
        inside = np.arange(len(places)) + w <= first[1:][doc[: len(places)]]
        chosen[places[inside]] = True
    for d in np.flatnonzero((count > 0) & (count < w)):
        part = hashes[first[d] : first[d + 1]]
        chosen[first[d] + len(part) - 1 - np.argmin(part[::-1])] = True
    at = np.flatnonzero(chosen)
    ends = np.searchsorted(at, first)
    return [
        (hashes[p], start[p] - off[d])
        for d in range(len(texts))
        for p in [at[ends[d] : ends[d + 1]]]
    ]


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    """The fingerprint as text: for each chosen run 8 digits of its hash and 8 of its position."""
    rows = np.empty((len(hashes), 2), ">u4")
    rows[:, 0], rows[:, 1] = hashes >> U(32), places
    return rows.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of chosen hashes; 1 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W
) -> DataFrame:
    """``doc_id, n_chars, hashes array<long>, positions array<long>, fingerprint`` per document.

    Null and empty texts have empty fingerprints; repeated rows give repeated rows; a null id stays
    null; an empty table gives none. Map-only.
    """
    key = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", most=SLICE):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = winnow(texts, k, w)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())),
                    pa.array([p for _, p in found], pa.list_(pa.int64())),
                    pa.array([digest(*f) for f in found], pa.string()),
                ],
                ["doc_id", "n_chars", "hashes", "positions", "fingerprint"],
            )

    schema = f"doc_id {key}, n_chars long, hashes array<long>, positions array<long>, fingerprint string"
    return map_arrow(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), run, schema)


def range_number(key: Column, bounds: list[Column]) -> Column:
    """How many of the ascending bounds are not above the key, found in two steps."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    groups = F.array(*[F.array(*bounds[i : i + step]) for i in range(0, len(bounds), step)])
    reached = F.size(F.filter(groups, lambda g: g[0] <= key))
    inside = F.size(F.filter(F.get(groups, reached - 1), lambda b: b <= key))
    return F.when(reached == 0, 0).otherwise((reached - 1) * step + inside)


def range_starts(keys: list[tuple], sizes: list[int], parts: int) -> list[tuple]:
    """Those of the ascending keys that begin the second and all further of ``parts`` ranges with
    about the same sum of sizes; fewer where a single key is larger."""
    ends = np.cumsum(np.array(sizes, np.int64))
    before = ends - np.array(sizes, np.int64)
    wanted = np.arange(1, parts) * (ends[-1] / parts) if len(keys) else np.zeros(0)
    return list(dict.fromkeys(keys[i] for i in np.searchsorted(before, wanted).tolist() if i < len(keys)))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, next_text``: each row with the text of the next one in descending id order
    (null ids last, equal ids in order of a hash of the text); the last row's next is the first.

    Rows are dealt out by ranges of the order in one shuffle and walked in place. The bounds of the
    ranges are constants, read from a bounded sample of ids and hashes by a first job, so the range
    of a row is the same wherever it is computed; the first and the last row of each range are
    looked up apart. There are as many ranges as shuffle partitions, or more, so that each holds
    about ``RANGE`` bytes of text at most and is sorted in memory; this matters to no result.
    """
    key = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("tie", F.xxhash64("text"))
    keys = slim.select("doc_id", "tie", (F.octet_length("text") + F.lit(ROW)).cast("long").alias("size"))
    rows, held = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE))
    place = F.struct("doc_id", "tie")
    hashed, limit = F.xxhash64("doc_id", "tie"), SAMPLED * parts
    few = keys.where((hashed.cast("double") / F.lit(2.0**64) + 0.5) * F.lit(float(rows)) <= 4.0 * limit)
    sample = few.orderBy(hashed, "doc_id", "tie").limit(limit).orderBy("doc_id", "tie").collect()
    chosen = range_starts([(d, t) for d, t, _ in sample], [n for _, _, n in sample], parts)
    bounds = [F.struct(F.lit(d).cast(key).alias("doc_id"), F.lit(t).cast("long").alias("tie")) for d, t in chosen]
    placed = slim.withColumn("part", range_number(place, bounds))
    order = [F.col("part").desc(), F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    ranged = placed.repartitionById(len(bounds) + 1, F.lit(len(bounds)) - F.col("part"))
    ranged = ranged.sortWithinPartitions(*order).select("part", "doc_id", "text")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for one in slices([batch], "text", most=SLICE):
                rows = pa.Table.from_batches([held, one] if held is not None else [one]).combine_chunks()
                if rows.num_rows > 1:
                    here, there = rows.slice(0, rows.num_rows - 1), rows.slice(1)
                    table = pa.table([here.column(1), here.column(2), there.column(2)], names=["doc_id", "text", "next_text"])
                    same = pa.array(here.column(0).to_numpy() == there.column(0).to_numpy())
                    yield from table.filter(same).combine_chunks().to_batches()
                held = rows.slice(rows.num_rows - 1).combine_chunks().to_batches()[0]

    inner = map_arrow(ranged, pairs, f"doc_id {key}, text string, next_text string")
    # Two rows per range: their number is that of the ranges, not of the documents.
    ends = placed.groupBy("part").agg(F.max(place).alias("first"), F.min(place).alias("last"))
    wanted = ends.select("first").union(ends.select("last")).distinct().select(F.col("first.doc_id").alias("d"), F.col("first.tie").alias("t"))
    texts = slim.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")))
    texts = texts.groupBy("d", "t").agg(F.min("text").alias("text")).select(place_of("d", "t"), "text")
    firsts = texts.select(F.col("place").alias("first"), F.col("text").alias("first_text"))
    lasts = texts.select(F.col("place").alias("last"), F.col("text").alias("text"))
    both = ends.join(firsts, "first").join(lasts, "last")
    down = Window.partitionBy(F.lit(0)).orderBy(F.col("part").desc())
    following = F.coalesce(F.lead("first_text").over(down), F.first("first_text").over(down))
    outer = both.withColumn("next_text", following).select(F.col("last.doc_id").alias("doc_id"), "text", "next_text")
    return inner.unionByName(outer)


def place_of(doc_id: str, tie: str) -> Column:
    return F.struct(F.col(doc_id).alias("doc_id"), F.col(tie).alias("tie")).alias("place")


def compare_with_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W
) -> DataFrame:
    """Fingerprints of each text and of an edited one, whose last third is taken from the next
    document, with the likeness of text and edited text, and of text and next text."""
    key = dict(docs.dtypes)[id_col]
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", "next_text", most=SLICE):
            texts, follow = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            edited = []
            for text, other in zip(texts, follow):
                cut = len(text) // 3
                edited.append(text[: len(text) - cut] + other[:cut])
            own, new, next_ = winnow(texts, k, w), winnow(edited, k, w), winnow(follow, k, w)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([digest(*f) for f in own], pa.string()),
                    pa.array([digest(*f) for f in new], pa.string()),
                    pa.array([likeness(a[0], b[0]) for a, b in zip(own, new)], pa.float64()),
                    pa.array([likeness(a[0], b[0]) for a, b in zip(own, next_)], pa.float64()),
                ],
                columns,
            )

    schema = (
        f"doc_id {key}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )
    return map_arrow(neighbours(docs, id_col, text_col), run, schema)
