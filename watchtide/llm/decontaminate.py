"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over token windows.

A word is a run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. A window is n consecutive
words of an item; an item of fewer words, but not none, is one window. A window whose number is in
the set is compared word by word before it counts. Nothing is shuffled.

Defined cases: null or word-less texts have no windows and no hits; null or word-less items have no
windows; a null item_id counts as the empty string; rows of one item_id are one item; repeated
documents are separate rows; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from watchtide.llm.text import U, Words, as_bytes, pick, steps

#: Windows that one broadcast holds. A larger benchmark is scanned for in blocks of so many windows,
#: one pass over the documents each; the results are the same.
WINDOWS_PER_BLOCK = 500_000

_WINDOWS = pa.schema([("window", pa.string()), ("n", pa.int32()), ("item_id", pa.string())])
_FOUND = "array<struct<first:long,n:int,item_ids:array<string>>>"


def windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(window, n, item_ids): the distinct normalised windows of all items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            ids, out = batch.column("item_id").to_pylist(), []
            words = Words(*as_bytes(batch.column("text")))
            for row in range(batch.num_rows):
                first, to = words.before[row], words.before[row + 1]
                for i in range(first, max(to - n + 1, min(first + 1, to))):
                    size = min(n, to - first)
                    out.append((words.joined(i, size).decode(), size, ids[row]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_WINDOWS)], schema=_WINDOWS)

    rows = pick(benchmark, item_id="string", text="string").withColumn("item_id", F.coalesce("item_id", F.lit("")))
    return rows.mapInArrow(cut, "window string, n int, item_id string").groupBy("window", "n").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


class Lookup:
    """One block of windows: sorted numbers per window length, and the words behind them."""

    def __init__(self, rows: list):
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.items = {r["window"].encode(): r["item_ids"] for r in rows}
        sizes: dict[int, list[bytes]] = {}
        for r in rows:
            sizes.setdefault(r["n"], []).append(r["window"].encode())
        for n, texts in sizes.items():
            data, offsets = as_bytes(pa.array(texts, pa.large_binary()))
            words = Words(data, offsets)
            numbers = np.unique(words.grams(n, words.hashes())[1])
            seen = np.zeros(1 << 20, bool)
            seen[numbers >> U(44)] = True
            self.by_size[n] = numbers, seen

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, length, item ids) of each occurrence, compared word by word."""
        hashes = words.hashes()
        for n, (numbers, seen) in self.by_size.items():
            at, number = words.grams(n, hashes)
            maybe = seen[number >> U(44)]
            at, number = at[maybe], number[maybe]
            place = np.minimum(np.searchsorted(numbers, number), len(numbers) - 1)
            for i in at[numbers[place] == number].tolist():
                items = self.items.get(words.joined(i, n))
                if items is not None:
                    yield i, n, items


def _blocks(benchmark: DataFrame, n: int) -> list[Broadcast]:
    """The windows in broadcast blocks of at most WINDOWS_PER_BLOCK; the driver holds one block at a time."""
    context, block, out = benchmark.sparkSession.sparkContext, [], []
    for row in windows(benchmark, n).toLocalIterator():
        block.append(row)
        if len(block) == WINDOWS_PER_BLOCK:
            out.append(context.broadcast(Lookup(block)))
            block = []
    return out + [context.broadcast(Lookup(block))] * bool(block)


def _lookups(blocks: list[Broadcast]) -> Iterator[Lookup]:
    """The blocks one after the other; of several, a worker holds one at a time and reads them again from its disk."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            vars(block).pop("_value", None)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids, spans (bytes from, to of each run of hit words)."""
    blocks = _blocks(benchmark, n)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, offsets = as_bytes(batch.column("text"))
            words = Words(data, offsets)
            edges, items = np.zeros(len(words) + 1, np.int64), {}
            for lookup in _lookups(blocks):
                for i, size, ids in lookup.hits(words):
                    edges[i] += 1
                    edges[i + size] -= 1
                    items.setdefault(int(words.doc[i]), set()).update(ids)
            hit = np.cumsum(edges[:-1]) > 0
            counts = np.bincount(words.doc[hit], minlength=batch.num_rows)
            same = np.zeros(len(words) + 1, bool)  # hit, and so is the word before in the same text
            same[1:-1] = hit[1:] & hit[:-1] & (words.doc[1:] == words.doc[:-1])
            first, last = np.flatnonzero(hit & ~same[:-1]), np.flatnonzero(hit & ~same[1:])
            spans: dict[int, list] = {}
            for i, j in zip(first.tolist(), last.tolist()):
                d = int(words.doc[i])
                spans.setdefault(d, []).append({"from": int(words.start[i] - offsets[d]), "to": int(words.end[j] - offsets[d])})
            rows = range(batch.num_rows)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(words.before), pa.int64()), pa.array(counts, pa.int64()), pa.array([len(items.get(r, ())) for r in rows], pa.int64()),
                pa.array([sorted(items.get(r, ())) for r in rows], pa.list_(pa.string())), pa.array([spans.get(r, []) for r in rows], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
            ], names=["doc_id", "n_words", "n_hit", "n_items", "item_ids", "spans"])

    return pick(docs, doc_id="long", text="string").mapInArrow(find, "doc_id long, n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<from:long,to:long>>")


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 10, whole_documents: bool = False) -> DataFrame:
    """The documents with all their columns; hit spans are cut from `text`, or hit documents dropped.

    A cut text is scanned again, until no window is left in it, and its `n_chars` counted anew. Texts without a hit stay as they are.
    """
    blocks = _blocks(benchmark, n)

    def cut(text: str) -> str:
        while True:
            raw = text.encode()
            words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            spans = sorted((int(words.start[i]), int(words.end[i + size - 1])) for x in _lookups(blocks) for i, size, _ in x.hits(words))
            if not spans:
                return text
            kept, at = [], 0
            for s, e in spans:
                kept.append(raw[at:s] if s > at else b"")
                at = max(at, e)
            text = b"".join([*kept, raw[at:]]).decode()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            place = batch.schema.get_field_index("text")
            words = Words(*as_bytes(batch.column(place)))
            hit = sorted({int(words.doc[i]) for x in _lookups(blocks) for i, _, _ in x.hits(words)})
            if whole_documents:
                yield batch.filter(pa.array(~np.isin(np.arange(batch.num_rows), hit)))
                continue
            if hit:
                texts = batch.column(place).to_pylist()
                for row in hit:
                    texts[row] = cut(texts[row])
                batch = batch.set_column(place, "text", pa.array(texts, batch.schema.field(place).type))
                count = batch.schema.get_field_index("n_chars")
                if count >= 0 and pa.types.is_integer(batch.schema.field(count).type):
                    sizes = batch.column(count).to_pylist()
                    for row in hit:
                        sizes[row] = len(texts[row])
                    batch = batch.set_column(count, "n_chars", pa.array(sizes, batch.schema.field(count).type))
            yield batch

    return docs.mapInArrow(clean, docs.schema)
