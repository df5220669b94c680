"""Best-fit packing of tokenised documents into sequences of bounded length.

Bounded-space online best-fit: each task keeps a fixed number of open sequences, found through a bitset
whose bit f says that a sequence with f free places is open. A piece goes where the least space stays
free; when a new sequence is needed and all are open, the fullest closes. Pieces of one Arrow batch
are offered longest first. Tasks need nothing from each other, so nothing is shuffled; a sequence's
number has the partition in its upper bits, and a task that is run again gives the same rows.

Defined cases: a null or empty text is the one token that ends a document; repeated rows are packed
as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from watchtide.llm.text import pick, steps
from watchtide.llm.tokens import Encoder

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Bins:
    """At most `most` open sequences, by free space."""

    def __init__(self, capacity: int, most: int, first_id: int = 0):
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.n_open = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.capacity, self.next_id
            self.next_id += 1
            if self.n_open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        left = free - length
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(at)
            self.n_open += 1
        return at, self.capacity - free


def pieces(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    first = length % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, open_bins: int = 2048) -> DataFrame:
    """One row per piece: its place in its document and in its sequence, and a checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        bins = Bins(capacity, open_bins, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], "<u4")
        for batch in steps(batches, limit=32 << 20):
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc, text in zip(ids, batch.column("text")):
                tokens = np.concatenate([np.asarray(encode(text.as_py() or ""), "<u4"), end])
                for k, (start, length) in enumerate(pieces(len(tokens), capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(tokens[start : start + length].tobytes())))
            rows.sort(key=lambda r: -r[3])
            placed = [bins.place(r[3]) for r in rows]
            columns = [*zip(*rows)] + [*zip(*placed)] if rows else [()] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)
