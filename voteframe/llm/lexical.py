"""Ranked lexical search over classes of equal bags.

Seen from the queries, a document is its bag: how often it holds each term that an item holds, and
its length factor m. Documents of equal bags have equal scores for every item, so

1. texts are read once and restricted to the items' vocabulary,
2. documents are grouped by the hash of bag and m; the bag itself is part of the key, so documents
   of different bags are never one class,
3. each class is scored once against all items of a block, over the items' postings, and a task
   keeps the best classes of each item only, and
4. the best classes are opened again: their members, by ascending id, take the ranks.

A common text is a class of many members and costs what one document costs. Items are worked on in
blocks of bounded text, the only thing that travels to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F

from voteframe.llm.common import map_arrow, slices
from voteframe.session import cut_lineage

TOP = 50
#: Bytes of item text, and items, that one block holds at most (a longer single item is a block).
BLOCK_BYTES, BLOCK_ITEMS = 8_000_000, 2_000
#: Cells of scores, and postings, that a task holds at once.
CELLS = 2_000_000
#: Bytes of a text that are cut into terms at once.
CHUNK = 1 << 20
LAST = 2**63 - 1
#: Terms are runs of digits, letters and whatever is not ASCII; A-Z count as small letters.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, a part of the text at a time."""
    plain = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + CHUNK)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


class Block:
    """Items with the ids of their distinct terms, as postings: ``items[start[t]:start[t + 1]]``
    are the places of the items that hold term ``t``."""

    def __init__(self, rows: list[Row]) -> None:
        self.ids = [r.item_id for r in rows]
        self.vocabulary: dict[bytes, int] = {}
        pairs = []
        for place, row in enumerate(rows):
            for term in {t for part in terms(row.text) for t in part}:
                pairs.append((self.vocabulary.setdefault(term, len(self.vocabulary)), place))
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.items = table[:, 1]
        self.start = np.searchsorted(table[:, 0], np.arange(len(self.vocabulary) + 1))


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """Blocks of items in order of id; only one is held."""
    rows: list[Row] = []
    held = 0
    named = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    for row in named.where("text <> ''").orderBy("item_id").toLocalIterator():
        size = len(row.text.encode("utf-8", "surrogatepass"))
        if rows and (held + size > BLOCK_BYTES or len(rows) == BLOCK_ITEMS):
            yield Block(rows)
            rows, held = [], 0
        rows.append(row)
        held += size
    if rows:
        yield Block(rows)


def bags(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, bag``: the number of terms of each document, and pairs of 32-bit numbers (term
    of the vocabulary, its occurrences) in order of term; null if it holds none. Map-only."""
    get = vocabulary.get

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, found = [], []
            for text in batch.column(1):
                n, tf = 0, np.zeros((0, 2), np.int64)
                for part in terms(text.as_py() or ""):
                    n += len(part)
                    known = np.fromiter(map(get, part, repeat(-1)), np.int64, len(part))
                    term, times = np.unique(known[known >= 0], return_counts=True)
                    tf = np.concatenate([tf, np.stack([term, times], 1)])
                if len(tf):  # parts may hold the same terms
                    term, place = np.unique(tf[:, 0], return_inverse=True)
                    times = np.zeros(len(term), np.int64)
                    np.add.at(times, place, tf[:, 1])
                    tf = np.stack([term, times], 1)
                counts.append(n)
                found.append(tf.astype("<u4").tobytes() if len(tf) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n", "bag"]
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(slim, rows, "doc_id long, n long, bag binary")


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and occurrences of all entries of a batch of bags."""
    texts = column.to_pylist()
    table = np.frombuffer(b"".join(texts), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(texts)), [len(t) // 8 for t in texts]), table[:, 0], table[:, 1]


def document_counts(classes: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary; a task returns a row per term at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, np.int64)
        for batch in batches:
            row, term, _ = entries(batch.column(0))
            np.add.at(held, term, batch.column(1).to_numpy()[row])
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(held[term])], ["term", "docs"])

    counted = map_arrow(classes.select("bag", "size"), rows, "term long, docs long")
    out = np.zeros(n_terms, np.int64)
    for row in counted.groupBy("term").agg(F.sum("docs").alias("docs")).toLocalIterator():
        out[row.term] = row.docs
    return out


class Best:
    """The best classes of each item so far: the highest scores, of equal ones the smallest first ids."""

    def __init__(self, n_items: int, top: int) -> None:
        self.top, self.least = top, np.ones(n_items, np.int64)
        self.rows = np.zeros((0, 6), np.int64)  # item, -score, first, key, m, size
        self.new: list[np.ndarray] = []
        self.n_new = 0

    def add(self, score: np.ndarray, first: np.ndarray, key: np.ndarray, m: np.ndarray, size: np.ndarray) -> None:
        row, item = np.nonzero(score >= self.least)
        self.new.append(np.stack([item, -score[row, item], first[row], key[row], m[row], size[row]], 1))
        self.n_new += len(row)
        if self.n_new > 4 * len(self.least) * self.top:
            self.prune()

    def prune(self) -> None:
        rows = np.concatenate([self.rows, *self.new])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        begin = np.searchsorted(rows[:, 0], np.arange(len(self.least)))
        place = np.arange(len(rows)) - begin[rows[:, 0]]
        self.rows, self.new, self.n_new = rows[place < self.top], [], 0
        full = rows[place == self.top - 1]
        self.least[full[:, 0]] = -full[:, 1]


def best_classes(classes: DataFrame, block: Block, weights: np.ndarray, top: int) -> DataFrame:
    """``item, score, first, key, m, size``: of each task the ``top`` best classes of each item."""
    items, start = block.items, block.start
    width, n_items = np.diff(block.start), len(block.ids)

    def scores(bag: pa.Array, m: np.ndarray) -> np.ndarray:
        row, term, tf = entries(bag)
        part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        times = width[term]
        ends = np.cumsum(times)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[term] - (ends - times), times)
        out = np.zeros(len(m) * n_items, np.int64)
        np.add.at(out, np.repeat(row, times) * n_items + items[place], np.repeat(part, times))
        return out.reshape(len(m), n_items)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_items, top)
        # A class has at most all postings of the block, and a score for each item.
        step = max(1, CELLS // max(n_items, len(items)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                m, size, first, key = (part.column(c).to_numpy() for c in ("m", "size", "first", "key"))
                best.add(scores(part.column(part.schema.get_field_index("bag")), m), first, key, m, size)
        best.prune()
        found = best.rows.copy()
        found[:, 1] *= -1
        names = ["item", "score", "first", "key", "m", "size"]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.T], names)

    schema = "item long, score long, first long, key long, m long, size long"
    return map_arrow(classes.select("bag", "m", "size", "first", "key"), rows, schema)


def first_rows(df: DataFrame, keys: list, order: list, top: int) -> DataFrame:
    """The first ``top`` rows of each key; Spark keeps ``top`` a task before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= top)


def search_block(docs: DataFrame, block: Block, id_col: str, text_col: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    found = cut_lineage(bags(docs, block.vocabulary, id_col, text_col), "bags")
    total = found.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total.docs, total.terms or 1
    share = f"cast(50 as decimal(2,0)) * cast(n as decimal(18,0)) * cast({n_docs} as decimal(18,0))"
    m = F.expr(f"50 + cast(({share}) div cast({n_terms} as decimal(20,0)) as bigint)")
    held = found.where("bag is not null").select("doc_id", "bag", m.alias("m")).withColumn("key", F.xxhash64("m", "bag"))
    classes = held.groupBy("key", "m", "bag").agg(
        F.count(F.lit(1)).alias("size"), F.coalesce(F.min("doc_id"), F.lit(LAST)).alias("first")
    )
    classes = cut_lineage(classes, "classes")
    holding = document_counts(classes, len(block.vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in holding], np.int64)
    order = [F.col("score").desc(), F.col("first"), F.col("key")]
    some = first_rows(best_classes(classes, block, weights, top), ["item", F.pmod("key", F.lit(32))], order, top)
    best = first_rows(some, ["item"], order, top).drop("__place")
    # A class matters to an item if fewer than ``top`` documents have higher scores.
    higher = Window.partitionBy("item").orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("higher", F.coalesce(F.sum(F.least("size", F.lit(top))).over(higher), F.lit(0)))
    best = cut_lineage(best.where(F.col("higher") < top).select("item", "score", "key", "m", "first"), "best")
    # At most ``top`` classes for each item of the block: the bound of what is broadcast.
    wanted = F.broadcast(best.select("key").distinct())
    members = first_rows(held.join(wanted, "key", "left_semi"), ["key", "m", "bag"], [F.col("doc_id").asc_nulls_last()], top)
    opened = classes.join(wanted, "key", "left_semi").select("key", "m", "bag", "first")
    members = members.drop("__place").join(opened, ["key", "m", "bag"]).select("key", "m", "first", "doc_id")
    listed = best.join(members, ["key", "m", "first"])
    ranked = first_rows(listed, ["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], top)
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(block.ids)), pa.int64()), "item_id": pa.array(block.ids)}))
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("__place").cast("int").alias("rank"), "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", top: int = TOP,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of the highest scores above 0 for each
    item, equal scores by ascending id; counts and lengths are those of all documents.

    Document ids are integers. A null or empty text has no terms: as a document it is not counted and
    never found, as an item it has no rows. Null document ids come after all others. Rows that
    repeat an id are documents of their own, as are repeated item rows (their ranks repeat). An
    empty table gives no rows. Other columns are not read.
    """
    out = None
    for block in blocks(items, item_col, item_text_col):
        if block.vocabulary:
            part = search_block(docs, block, id_col, text_col, top)
            out = part if out is None else out.unionByName(part)
    if out is None:
        kind = dict(items.dtypes)[item_col]
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The same without classes: every document against every item that shares a term.
SEARCH_SQL = f"""
with terms as (select doc_id, unnest({_TERMS}) as term from documents),
held as (select doc_id, term, count(*) as tf from terms group by doc_id, term),
lengths as (select doc_id, sum(tf)::bigint as n from held group by doc_id),
total as (select count(*) as n_docs, sum(n)::bigint as n_terms from lengths),
holding as (select term, count(*) as docs from held group by term),
wanted as (select distinct item_id, term from (select item_id, unnest({_TERMS}) as term from benchmark)),
weighted as (select item_id, term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * docs + 1)::double))::bigint as w
  from wanted join holding using (term), total),
factors as (select doc_id, 50 + (50 * n * n_docs) // n_terms as m from lengths, total),
scored as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
  from weighted join held using (term) join factors using (doc_id) group by item_id, doc_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as place, doc_id, score
  from scored where score > 0)
select item_id, place::int as rank, doc_id, score from ranked where place <= 50
"""
