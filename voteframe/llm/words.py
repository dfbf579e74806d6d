"""Words of whole Arrow batches as NumPy arrays: places, documents and 64-bit hashes.

A word is a run of characters other than space and \\x09-\\x0D. In UTF-8 those are single bytes
that occur in no other character, so words are found on the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown when longer texts come."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, U)
                steps[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = {base: Powers(base) for base in (_BASE, _STEP)}


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for each pair, independent of the place."""
    up, down = _POWERS[base].get(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[:-1], out=sums[1:])
        return (sums[end] - sums[start]) * down[start]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty), and the offsets of the texts in them."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a batch of texts. ``first[d]:first[d + 1]`` are the words of text ``d``."""

    def __init__(self, column: pa.Array) -> None:
        self.raw, self.off = text_bytes(column)
        n = len(self.raw)
        self.space = SPACE[self.raw]
        inside = ~self.space
        bound = np.zeros(n + 1, bool)
        bound[self.off] = True
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = self.space[:-1]
        self.start = np.flatnonzero(inside & (before | bound[:n]))
        after = np.empty(n, bool)
        after[-1:] = True
        after[:-1] = self.space[1:]
        self.end = np.flatnonzero(inside & (after | bound[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.doc = np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))
        with np.errstate(over="ignore"):
            hashed = range_hashes(self.raw.astype(U) + U(1), self.start, self.end, _BASE)
            self.hash = mix(hashed + (self.end - self.start).astype(U) * U(_STEP))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of ``k`` words inside one text, and the hashes of the runs."""
        last = self.first[1:] - k
        at = np.arange(len(self.start))
        at = at[at <= last[self.doc]] if len(at) else at
        return at, mix(range_hashes(self.hash, at, at + k, _STEP) + U(k))

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Number of set marks among the words of each text."""
        sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return np.diff(sums[self.first])

    def bytes_per_text(self, marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return np.diff(sums[self.off])


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Marks of ``n`` words that lie in a run of ``k`` words starting at one of ``at``."""
    steps = np.zeros(n + k + 1, np.int32)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + k, -1)
    return np.cumsum(steps)[:n] > 0
