"""Packing by reciprocal-capacity classes (harmonic packing).

A document's tokens are cut into full sequences and, for the rest, pieces of exactly capacity / k
for k = 2, 4, 8, ...: the binary digits of the rest. Class k's sequences hold k pieces each, so a
filled sequence has no padding. Every worker fills the sequences of each class by itself; what is
left of a class at its end is split by the binary digits of the count, so that these sequences are
as long as a power of two and need no padding either. Nothing is shuffled; a worker holds one open
sequence per class.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from voteframe.llm.common import map_arrow

CAPACITY = 1024
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str):
    """The byte-level encoding whose ranks the file lists, with the added tokens of the JSON file of
    the same name, if there is one."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    listed = Path(path).with_suffix(".json")
    added = json.loads(listed.read_text("utf-8"))["added_tokens"] if listed.exists() else []
    special = {token["content"]: token["id"] for token in added}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, path: str, end_id: int) -> np.ndarray:
    """Ids of the text, in which an added token has its own id, and the end token."""
    ids = encoder(path).encode(text, allowed_special="all") if text else []
    ids.append(end_id)
    return np.array(ids, "<u4")


def cuts(tokens: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full sequences, then the binary digits of the rest."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Bins:
    """The open sequence of each class on one worker; rows leave when their sequence is filled."""

    def __init__(self, capacity: int, worker: int) -> None:
        self.capacity, self.next_id = capacity, worker << 40
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def add(self, size: int, piece: tuple) -> None:
        held = self.open.setdefault(size, [])
        held.append(piece)
        if len(held) * size == self.capacity:
            self.close(size, held)
            self.open[size] = []

    def close(self, size: int, pieces: list[tuple]) -> None:
        for slot, piece in enumerate(pieces):
            self.rows.append((*piece, self.next_id, slot * size, len(pieces) * size))
        self.next_id += 1

    def finish(self) -> None:
        for size, held in self.open.items():
            while held:
                count = 1 << (len(held).bit_length() - 1)
                self.close(size, held[:count])
                held = held[count:]
        self.open = {}

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    path: str | None = None, end_id: int = 0,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens``.

    ``capacity`` must be a power of two. A null or empty text is the end token alone. Repeated rows
    and equal ids are packed once per row; a null id stays null; other columns are not read; an
    empty table gives no rows. Sequence ids are unique across workers and repeatable.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = path or vocabulary_path()
    key = dict(docs.dtypes)[id_col]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, TaskContext.get().partitionId())
        kind = None

        def emit() -> pa.RecordBatch:
            columns = list(zip(*bins.take()))
            kinds = [kind] + [pa.int64()] * (len(names) - 1)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = token_ids(text, path, end_id)
                total, start = len(ids), 0
                for size in cuts(total, capacity):
                    crc = zlib.crc32(ids[start : start + size])
                    bins.add(size, (doc, start, size, crc, total))
                    start += size
            if bins.rows:
                yield emit()
        bins.finish()
        if bins.rows:
            yield emit()

    rest = ", ".join(f"{n} long" for n in names[1:])
    return map_arrow(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, f"doc_id {key}, {rest}")
