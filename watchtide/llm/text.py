"""Helpers on whole Arrow batches of texts, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

U = np.uint64
#: Bytes of text that one vectorised step handles; a longer single text is one step of its own.
STEP = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_PLACE = _rng.integers(1, 2**63, 4096, dtype=np.uint64) | U(1)


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; whatever else the table has cannot clash."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()])


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes end to end, and len + 1 offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text."""
    for batch in batches:
        _, offsets = as_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Words of a batch: runs of digits, a-z (A-Z are lower-cased) and bytes from 0x80, within a text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = _LOWER[data]
        inside = _WORD[low]
        first, last = inside.copy(), inside.copy()
        if len(low):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = offsets[:-1][offsets[:-1] < len(low)]
            first[edge] |= inside[edge]
            edge = edge[edge > 0] - 1
            last[edge] |= inside[edge]
        self.low, self.start, self.end = low, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        #: words before each text
        self.before = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit number for each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        at = np.arange(int(size.sum()), dtype=np.int64)
        shift = np.cumsum(size) - size
        inner = at - np.repeat(shift, size)
        values = _BYTE[self.low[at + np.repeat(self.start - shift, size)]] * _PLACE[inner & 4095]
        return mix(np.add.reduceat(values, shift) + size.astype(np.uint64))

    def grams(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start word and 64-bit number of each run of n words within a text."""
        count = len(self) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        total = np.zeros(len(at), np.uint64)
        for j in range(n):
            total = total * U(0x9E3779B97F4A7C15) + hashes[at + j]
        return at, mix(total)

    def joined(self, i: int, n: int) -> bytes:
        """The n words from word i on, with single spaces."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[i : i + n], self.end[i : i + n]))
