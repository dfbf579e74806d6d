"""Removal of passages that repeat across documents: the suffix trees of all texts, cut at depth 50.

The suffixes of a text begin at its words. Only nodes at the depth of a window (50 words) matter: a
node that suffixes of two documents reach is a repeat, and its smallest document keeps it. Suffixes
are partitioned by a prefix of variable length, namely up to the end of the smallest run of ten
words within the window (the rightmost of equal ones); equal windows have equal prefixes end, so they
fall into the same partition. Neighbouring suffixes of one text and one partition form a stretch and
travel as one row with a hash of all its words.

1. Partitions that a single document reaches have no repeats; their stretches are dropped.
2. Equal stretches of a partition are counted together: all but those of the smallest document are
   repeats as a whole. Each different stretch is then a branch of the partition's subtree.
3. Where a partition has several branches, the nodes at depth 50 of one copy of each branch are
   formed from its text, and the nodes that branches of two documents share are marked.

Partitions and nodes are keys of aggregations that combine before they shuffle, so a passage that a
third of all documents share is no group that any task holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voteframe.llm.common import map_arrow, slices
from voteframe.llm.fingerprints import window_minima
from voteframe.llm.words import _BASE, Words, covered, mix, range_hashes
from voteframe.session import cut_lineage

WINDOW, RUN = 50, 10
U = np.uint64


def stretches(words: Words, window: int, run: int) -> dict[str, np.ndarray]:
    """Maximal sequences of suffixes of one text whose windows end their prefix at the same place:
    ``doc, start`` (first word in the text), ``n`` (suffixes), ``part``, ``branch``."""
    at, grams = words.grams(run)
    width = window - run + 1
    if len(at) < width:
        none = np.zeros(0, np.int64)
        return {"doc": none, "start": none, "n": none, "part": none, "branch": none}
    place = window_minima(grams, width)
    valid = np.flatnonzero(at[width - 1 :] - at[: len(place)] == width - 1)
    place, first_word = place[valid], at[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (place[1:] != place[:-1]) | (np.diff(first_word) != 1)
    heads = np.flatnonzero(new)
    n = np.diff(np.concatenate([heads, [len(valid)]]))
    begin = first_word[heads]
    doc = words.doc[begin] if len(begin) else begin
    with np.errstate(over="ignore"):
        branch = mix(range_hashes(words.hash, begin, begin + n + window - 1, _BASE) + n.astype(U))
    return {
        "doc": doc, "start": begin - words.first[doc], "n": n, "part": grams[place[heads]].view(np.int64),
        "branch": branch.view(np.int64),
    }


def all_stretches(docs: DataFrame, window: int, run: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = stretches(Words(batch.column(1)), window, run)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found["part"]), pa.array(found["branch"]), pa.array(ids[found["doc"]].astype(np.int64)),
                 pa.array(found["start"].astype(np.int32)), pa.array(found["n"].astype(np.int32))],
                ["part", "branch", "doc", "start", "n"],
            )

    return map_arrow(docs, rows, "part long, branch long, doc long, start int, n int")


def nodes(texts: DataFrame, window: int) -> DataFrame:
    """The nodes of the wanted suffixes: ``part, branch, off, node, doc``. ``texts``: ``doc_id,
    text, wanted array<struct<part, branch, start, n>>``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(1))
            at, hashes = words.grams(window)
            index = np.full(len(words.start) + 1, -1)
            index[at] = np.arange(len(at))
            wanted = batch.column(2)
            flat, sizes = wanted.flatten(), np.diff(wanted.offsets.to_numpy())
            part, branch, start, n = (flat.field(f).to_numpy() for f in ("part", "branch", "start", "n"))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            row = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = words.first[doc[row]] + start[row] + off
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[row]), pa.array(branch[row]), pa.array(off.astype(np.int32)),
                 pa.array(hashes[index[first]].view(np.int64)), pa.array(ids[doc[row]])],
                ["part", "branch", "off", "node", "doc"],
            )

    return map_arrow(texts, rows, "part long, branch long, off int, node long, doc long")


def repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN
) -> DataFrame:
    """``doc_id, repeats array<struct<start int, marks long>>``: bit i of ``marks`` tells that the
    window beginning at word ``start + i`` also begins in a document with a smaller id. Documents
    without repeats have no row."""
    if not 0 <= window - run < 62:
        raise ValueError("a stretch must have at most 62 windows")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where(F.col("doc_id").isNotNull())
    found = all_stretches(texts, window, run)
    shared = found.groupBy("part").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("part")
    found = cut_lineage(found.join(shared, "part"), "stretches")
    branches = found.groupBy("part", "branch").agg(F.min(F.struct("doc", "start", "n")).alias("one"))
    many = branches.groupBy("part").agg(F.count(F.lit(1)).alias("branches")).where("branches > 1").select("part", F.lit(True).alias("mixed"))
    branches = cut_lineage(branches.join(many, "part", "left").select("part", "branch", "one.*", "mixed"), "branches")
    wanted = branches.where("mixed").groupBy("doc").agg(F.collect_list(F.struct("part", "branch", "start", "n")).alias("wanted"))
    # A document's list is no longer than the document.
    reached = cut_lineage(nodes(texts.join(wanted, texts["doc_id"] == wanted["doc"]).select("doc_id", "text", "wanted"), window), "nodes")
    lowest = reached.groupBy("part", "node").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    marked = reached.join(lowest.select("part", "node", "low"), ["part", "node"]).where("doc > low")
    marks = marked.groupBy("part", "branch").agg(F.expr("bit_or(shiftleft(1L, off))").alias("marks"))
    known = branches.select("part", "branch", F.col("doc").alias("low")).join(marks, ["part", "branch"], "left")
    whole = F.expr("shiftleft(1L, n) - 1")
    placed = found.join(known, ["part", "branch"]).select(
        "doc", "start", F.when(F.col("doc") > F.col("low"), whole).otherwise(F.col("marks")).alias("marks")
    )
    return placed.where("marks <> 0").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "marks")).alias("repeats"))


def window_starts(marks: pa.Array) -> list[np.ndarray | None]:
    """First words of all marked windows, for each row of ``repeats``."""
    out: list[np.ndarray | None] = []
    for row in marks:
        if not row.is_valid:
            out.append(None)
            continue
        start = row.values.field("start").to_numpy()
        bits = row.values.field("marks").to_numpy()
        on = (bits[:, None] >> np.arange(62)[None, :]) & 1
        at, off = np.nonzero(on)
        out.append(start[at] + off)
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN
) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept``: the words of each document that no repeated
    window covers, joined by one space, and ``spans array<struct<start, end>>`` of the removed words.

    Null and empty texts have no words; texts shorter than the window lose nothing. Ids are
    integers and name one text; rows that repeat an id are not smaller than each other. Rows with a
    null id are neither judged nor judge others: they keep all words. An empty table gives no rows.
    """
    found = repeats(docs, id_col, text_col, window, run)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, removed, spans, kept = [], [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), window_starts(batch.column(2))):
                words = (text or "").encode().split()
                gone = covered(len(words), starts, window) if starts is not None else np.zeros(0, bool)
                counts.append(len(words))
                removed.append(int(gone.sum()))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                if len(edges):
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept.append(b" ".join(words).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    joined = texts.join(found.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "repeats")
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start long, end long>>, kept string"
    return map_arrow(joined, rows, schema)
