"""N-gram Jaccard join by MinHash banding, with exact verification.

Every distinct set of word shingles has a signature of 32 bands. All bands have one fixed length, the
longest that finds a pair at the threshold with the target recall; it follows from these constants and
not from the data, so this is banding and not a forest of tries whose prefixes are shortened for a set.
Sets that share a band are linked to the smallest of them, which gives candidate clusters; a cluster's
texts meet once, in blocks of bounded size, where the similarity of every pair is computed exactly.
What leaves a block is one row per set (its number of links and the smallest set it is connected with),
never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voteframe.llm.common import map_arrow, slices, small_batches
from voteframe.llm.components import components
from voteframe.llm.words import _STEP, Words, mix, range_hashes
from voteframe.session import cut_lineage

U = np.uint64
SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 32, 12, 0.995
#: Sets, and shingles, of a cluster that one block holds at most (a larger single text is taken whole).
BLOCK_SETS, BLOCK_SHINGLES = 512, 1_000_000


def matched_depth(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest band at which pairs at the threshold share one with the target recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes in order of text and place, the texts they belong to, and where each text's
    begin. A text of fewer than ``k`` words is one shingle, one without words has none."""
    n = np.diff(words.first)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    start = np.arange(first[-1]) - first[:-1][doc] + words.first[:-1][doc]
    run = np.minimum(n, k)[doc]
    with np.errstate(over="ignore"):
        return mix(range_hashes(words.hash, start, start + run, _STEP) + run.astype(U)), doc, first


def first_of_equals(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks one of each text's equal hashes."""
    order = np.argsort(hashes ^ mix(doc.astype(U) + U(1)), kind="stable")
    h, d = hashes[order], doc[order]
    once = np.ones(len(h), bool)
    once[order[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])]] = False
    return once


def sums_per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return sums[first[1:]] - sums[first[:-1]]


def prefix_keys(hashes: np.ndarray, first: np.ndarray, trees: int, depth: int, seed: int = 7) -> np.ndarray:
    """For each text with shingles, the key of its prefix of ``depth`` minima in each trie."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, (trees, depth), dtype=U) * U(2) + U(1)
    shifts = rng.integers(0, 1 << 63, (trees, depth), dtype=U)
    full = np.flatnonzero(np.diff(first))
    keys = np.zeros((len(full), trees), U)
    begin = 0
    with np.errstate(over="ignore"):
        while begin < len(full):  # pieces that stay in the processor's cache
            end = max(begin + 1, int(np.searchsorted(first[full], first[full[begin]] + 32_768)))
            part = hashes[first[full[begin]] : first[full[end - 1] + 1]]
            starts = first[full[begin:end]] - first[full[begin]]
            for t in range(trees):
                key = np.full(end - begin, t + 1, U)
                for j in range(depth):
                    key = mix(key * U(_STEP) + np.minimum.reduceat(part * factors[t, j] + shifts[t, j], starts))
                keys[begin:end, t] = key
            begin = end
    return keys


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, trees: int, depth: int) -> DataFrame:
    """``doc_id, d1, d2`` (a digest of the set of shingles), ``n`` (shingles), ``keys``."""
    key = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, doc, first = shingles(Words(batch.column(1)), k)
            once = first_of_equals(hashes, doc)
            digests = [
                sums_per_text(np.where(once, mix(hashes ^ U(salt)), U(0)), first).view(np.int64) for salt in (0x5bd1e995, 0x1b873593)
            ]
            rows: list = [[] for _ in range(len(first) - 1)]
            full = np.flatnonzero(np.diff(first))
            for d, row in zip(full, prefix_keys(hashes, first, trees, depth).view(np.int64)):
                rows[d] = row
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *map(pa.array, digests), pa.array(sums_per_text(once.astype(np.int64), first)),
                    pa.array(rows, pa.list_(pa.int64())),
                ],
                ["doc_id", "d1", "d2", "n", "keys"],
            )

    wanted = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return map_arrow(wanted, run, f"doc_id {key}, d1 long, d2 long, n long, keys array<long>")


def linked(a: np.ndarray, b: np.ndarray, doc: np.ndarray, ids: np.ndarray, threshold: float) -> np.ndarray:
    """Which of texts ``a`` and texts ``b`` reach the threshold. ``doc, ids``: each text's distinct
    shingles as numbers."""
    n = int(max(a.max(), b.max())) + 1
    sizes = np.bincount(doc, minlength=n)
    shared = np.bincount(ids)[ids] > 1
    doc, (_, ids) = doc[shared], np.unique(ids[shared], return_inverse=True)
    order = np.argsort(ids, kind="stable")
    doc, ids = doc[order], ids[order]
    both = np.zeros((len(a), len(b)))
    width = 4096
    for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        s = slice(*np.searchsorted(ids, [low, low + width]))
        marks = np.zeros((n, width), np.float32)
        marks[doc[s], ids[s] - low] = 1
        both += marks[a] @ marks[b].T
    union = sizes[a][:, None] + sizes[b][None, :] - both
    return both >= threshold * union - 1e-9


def verify_block(table: pa.Table, k: int, threshold: float) -> pa.Table:
    """One row per set of a pair of blocks: ``rep, links, root``."""
    reps, at = np.unique(table.column("rep").to_numpy(), return_index=True)
    table = table.take(pa.array(at))
    size, block = table.column("size").to_numpy(), table.column("block").to_numpy()
    hashes, doc, first = shingles(Words(table.column("text").combine_chunks()), k)
    once = first_of_equals(hashes, doc)
    doc, (_, ids) = doc[once], np.unique(hashes[once], return_inverse=True)
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    links, root = np.zeros(len(reps), np.int64), np.arange(len(reps))
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if len(a) and len(b):
        near = linked(a, b, doc, ids, threshold)
        if i == j:
            np.fill_diagonal(near, False)
        links[a] += near @ size[b]
        if i != j:
            links[b] += near.T @ size[a]
        far = len(reps)
        while True:  # the smallest set within reach, one step further each time
            new = root.copy()
            new[a] = np.minimum(new[a], np.where(near, root[b][None, :], far).min(1))
            new[b] = np.minimum(new[b], np.where(near.T, new[a][None, :], far).min(1))
            new = new[new]
            if (new == root).all():
                break
            root = new
    keep = links > 0
    return pa.table({"rep": reps[keep], "links": links[keep], "root": reps[root[keep]]})


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD,
    trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
) -> DataFrame:
    """One row per document: ``doc_id, class_id, group_id, n_links``.

    ``class_id`` is the smallest id among the documents with the same set of shingles, ``group_id``
    the smallest id connected by links, ``n_links`` the number of other documents of a similarity of
    at least ``threshold``, copies included. Texts of fewer than ``k`` words are compared whole;
    null and empty texts are alike and linked to each other only. Repeated rows count as documents.
    A null id takes part as a copy only: if all of a class are null, its ids are null and it has no
    links outside it. Ids must be integers, and name one text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    used = matched_depth(trees, depth, threshold, recall)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut_lineage(signatures(rows, "doc_id", "text", k, trees, used), "signatures")
    sets = signed.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.max("n").alias("n"),
        F.min_by("keys", "doc_id").alias("keys"),
    )
    sets = cut_lineage(sets, "sets")
    entries = sets.where("rep is not null").select("rep", F.explode("keys").alias("key"))
    hubs = entries.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    edges = entries.join(hubs.select("key", "hub"), "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    clusters = components(edges).withColumnRenamed("node", "rep")
    placed = clusters.join(sets.select("rep", "size", "n"), "rep")
    totals = placed.groupBy("component").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.lit(1))
    totals = totals.select("component", blocks.cast("int").alias("blocks"))
    placed = placed.join(totals, "component").select(
        "rep", "size", "component", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")
    )
    placed = cut_lineage(placed, "placed")
    texts = rows.join(placed, rows["doc_id"] == placed["rep"]).drop("doc_id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = texts.select("rep", "size", "component", "block", "text", other).select(
        "rep", "size", "component", "block", "text", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    found = spread.groupBy("component", "i", "j").applyInArrow(
        lambda t: verify_block(t, k, threshold), "rep long, links long, root long"
    )
    found = cut_lineage(found, "links")
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    answers = sets.select("d1", "d2", "rep", "size").join(groups, "rep", "left").join(counts, "rep", "left").select(
        "d1", "d2", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"),
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
    )
    return signed.select("doc_id", "d1", "d2").join(answers, ["d1", "d2"]).select("doc_id", "class_id", "group_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, of which the smallest id of each group stays. Rows with a null id
    stay: nothing tells them apart. Repeated rows of an id that stays are reduced to one."""
    found = jaccard_join(docs, id_col, text_col, **options)
    stays = found.where(F.col("doc_id") == F.col("group_id")).select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(stays, F.col(id_col).cast("long") == F.col("__id"), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
