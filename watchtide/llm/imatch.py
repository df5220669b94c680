"""I-Match fingerprints over randomised lexicons.

Terms whose document frequency lies in a band are kept, put in order, and hashed once per lexicon: lexicon s keeps a
term with probability 1/2, 1/4, ... by the term's own number, so that about one term of a document is left in it.
A document uses a few rates from the one that suits its number of terms on. Two fingerprints are as alike as the share of
their non-empty lexicons, at a common rate, that give the same hash.

The frequencies come from all documents. The band is a share of their number, which bounds the lexicon whatever the input's
size: at most the mean number of distinct terms in a document, over `LOW`.

Defined cases: a text with fewer than LEAST terms in the band uses all its terms; one without words is its own single
term; null and empty texts have the fingerprint `empty`; equal fingerprints have likeness 1; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from watchtide.llm.text import STEP, U, Words, as_bytes, mix, pick, steps

#: Shares of all documents in which a kept term occurs.
LOW, HIGH = 0.0005, 0.1
LEAST = 4
LEXICONS, RATES = 32, 4
#: Distinct terms that a counting task holds before it sends them on.
HELD = 4_000_000


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of the distinct words of each text, in order."""
    words = Words(data, offsets)
    doc, number = words.doc, words.hashes()
    for row in np.flatnonzero((np.diff(words.before) == 0) & (np.diff(offsets) > 0)):
        whole = int.from_bytes(hashlib.sha256(data[offsets[row] : offsets[row + 1]].tobytes()).digest()[:8], "big")
        doc, number = np.append(doc, row), np.append(number, U(whole))
    order = np.lexsort((number, doc))
    doc, number = doc[order], number[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
    return doc[new], number[new]


def fit(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Numbers, in order, of the terms in the band."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def put() -> pa.RecordBatch:
            number, of = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(of, np.concatenate([x for _, x in held]), len(number)).astype(np.int64)
            held[:] = [(number, n)]
            return pa.RecordBatch.from_arrays([pa.array(number.view(np.int64)), pa.array(n)], names=["term", "n"])

        for batch in steps(batches):
            held.append(np.unique(terms(*as_bytes(batch.column("text")))[1], return_counts=True))
            if len(held) > 8:
                out = put()
                if out.num_rows > HELD:
                    yield out
                    held.clear()
        if held:
            yield put()

    total = docs.count()
    found = pick(docs, text="string").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = found.where((F.col("n") >= F.lit(low * total)) & (F.col("n") <= F.lit(high * total))).select("term").toArrow()
    return np.sort(kept["term"].to_numpy().view(np.uint64))


class Prints:
    """Fingerprints of a batch: the first rate's exponent, and a 16-bit hash per rate and lexicon (0: nothing left)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray):
        n = len(offsets) - 1
        doc, number = terms(data, offsets)
        place = np.minimum(np.searchsorted(lexicon, number), max(len(lexicon) - 1, 0))
        inside = lexicon[place] == number if len(lexicon) else np.zeros(len(number), bool)
        few = np.bincount(doc[inside], minlength=n) < LEAST
        keep = inside | few[doc]
        doc, number = doc[keep], number[keep]
        size = np.bincount(doc, minlength=n)
        self.rate = np.where(size > 0, np.frexp(np.maximum(size, 1))[1] - 1, -1)
        sums = np.zeros((n, RATES, LEXICONS), np.uint64)
        mask = np.full(len(number), (1 << LEXICONS) - 1, np.uint64)
        draw = 0
        while len(doc):
            for k in range(RATES):  # those that have had as many draws as their rate asks for
                done = self.rate[doc] + k == draw
                self._add(sums, doc[done], number[done], mask[done], k)
            go = (self.rate[doc] + RATES - 1 > draw) & (mask != 0)
            doc, number, mask = doc[go], number[go], mask[go]
            draw += 1
            mask &= mix(number + U(draw * 0x9E3779B97F4A7C15 % 2**64))
        self.hash = np.where(sums != 0, mix(sums) % U((1 << 16) - 1) + U(1), U(0)).astype(np.uint32)

    @staticmethod
    def _add(sums: np.ndarray, doc: np.ndarray, number: np.ndarray, mask: np.ndarray, k: int) -> None:
        bits = (mask[:, None] >> np.arange(LEXICONS, dtype=np.uint64)) & U(1)
        at, which = np.nonzero(bits)
        np.add.at(sums, (doc[at], k, which), mix(number[at] ^ U(0xD1B54A32D192ED03)) | U(1))

    def __len__(self) -> int:
        return len(self.rate)

    def texts(self) -> list[str]:
        return ["empty" if r < 0 else f"{r:02d}" + "".join(f"{x:04x}" for x in h.ravel().tolist()) for r, h in zip(self.rate.tolist(), self.hash)]

    def likeness(self, other: "Prints") -> np.ndarray:
        """Of each fingerprint to the one in the same place of another batch."""
        same, full = np.zeros(len(self)), np.zeros(len(self))
        for mine in range(RATES):
            for its in range(RATES):
                common = (self.rate + mine == other.rate + its) & (self.rate >= 0) & (other.rate >= 0)
                a, b = self.hash[:, mine], other.hash[:, its]
                same += common * ((a == b) & (a != 0)).sum(1)
                full += common * ((a != 0) | (b != 0)).sum(1)
        equal = (self.rate == other.rate) & (self.hash == other.hash).all((1, 2))
        return np.where(equal, 1.0, same / np.maximum(full, 1))

    def rows(self, at: np.ndarray) -> "Prints":
        out = object.__new__(Prints)
        out.rate, out.hash = self.rate[at], self.hash[at]
        return out


def fingerprints(docs: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """(doc_id, fingerprint) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = Prints(*as_bytes(batch.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.texts(), pa.string())], names=["doc_id", "fingerprint"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """(part, spare, place, tie, doc_id, packed): descending doc_id within each part, parts in order too; texts are compressed on the way.

    The first row of each part is there a second time, as the spare last row of the part before, so that every row's
    follower is in its own part; the last part's spare is the first row of all. Null doc_ids come last; equal ones go by text.
    """
    rows = pick(docs, doc_id="long", text="string").withColumns({"place": F.coalesce("doc_id", F.lit(-(2**63))), "tie": F.xxhash64("text")})
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array(sorted({int(x) for x in rows.select("place").approxQuantile("place", [k / n for k in range(1, n)], 0.2 / n)}), np.int64)
    part = lambda place: len(cuts) - np.searchsorted(cuts, place, "right")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, tie = (batch.column(c).to_numpy() for c in ("place", "tie"))
            of = part(place)
            at = np.lexsort((tie, place, of))
            at = at[np.append(of[at][1:] != of[at][:-1], True)] if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(of[at].astype(np.int32)), pa.array(place[at]), pa.array(tie[at])], names=["part", "place", "tie"])

    tops = rows.select("place", "tie").mapInArrow(heads, "part int, place long, tie long").groupBy("part").agg(F.max(F.struct("place", "tie")).alias("top"))
    first = sorted(tops.collect(), key=lambda r: r["part"])  # a row per part
    top, before = np.zeros((len(cuts) + 1, 2), np.int64), np.zeros(len(cuts) + 1, np.int32)
    for k, r in enumerate(first):
        top[r["part"]], before[r["part"]] = (r["top"]["place"], r["top"]["tie"]), first[k - 1]["part"]
    # a number for each part that shuffles to a task of its own
    own = spark.range(32 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("task")).agg(F.min("id").alias("id")).collect()
    deal = np.arange(len(cuts) + 1, dtype=np.int64)
    for r in own:
        if r["task"] < len(deal):
            deal[r["task"]] = r["id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=6).compress
        for batch in steps(batches):
            packed = pa.array([None if t is None else press(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            place, tie = (batch.column(c).to_numpy() for c in ("place", "tie"))
            of = part(place).astype(np.int32)
            spare = np.flatnonzero((top[of, 0] == place) & (top[of, 1] == tie))
            both = pa.array(np.append(np.arange(len(of)), spare))
            to = np.append(of, before[of[spare]])
            late = np.append(np.zeros(len(of), np.int32), np.ones(len(spare), np.int32))
            columns = [pa.array(deal[to]), pa.array(to), pa.array(late), *[c.take(both) for c in (batch.column("place"), batch.column("tie"), batch.column("doc_id"), packed)]]
            yield pa.RecordBatch.from_arrays(columns, names=["task", "part", "spare", "place", "tie", "doc_id", "packed"])

    small = rows.select("place", "tie", "doc_id", "text").mapInArrow(pack, "task long, part int, spare int, place long, tie long, doc_id long, packed binary")
    return small.repartition(n, "task").drop("task").sortWithinPartitions("part", "spare", F.desc("place"), F.desc("tie"))


def edited(docs: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the code points replaced by as many, or all, from the start of
    the next document in descending doc_id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def result(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows for all but the last text."""
        thirds = [len(t) // 3 for t in texts]
        changed = [t[: len(t) - k] + after[:k] for t, k, after in zip(texts, thirds, texts[1:])]
        raw = [t.encode() for t in changed]
        lexicon = shared.value
        own, new = (Prints(*as_bytes(pa.array(x, pa.large_binary())), lexicon) for x in ([t.encode() for t in texts], raw))
        mine, after = own.rows(np.arange(len(raw))), own.rows(np.arange(1, len(raw) + 1))
        columns = [ids[: len(raw)], [len(t) for t in texts[:-1]], [hashlib.sha256(x).hexdigest() for x in raw], mine.texts(), new.texts(), mine.likeness(new), mine.likeness(after)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts, held, over = None, [], [], 0, False
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at, spare, doc_id, packed in zip(*(batch.column(c) for c in ("part", "spare", "doc_id", "packed"))):
                if at.as_py() != part:
                    part, ids, texts, held, over = at.as_py(), [], [], 0, False
                if over:  # equal first rows give equal spares
                    continue
                over = bool(spare.as_py())
                text = unpack(packed.as_py()).decode() if packed.is_valid else ""
                ids.append(doc_id.as_py())
                texts.append(text)
                held += len(text)
                if over or held > STEP and len(texts) > 1:  # the last text waits for its follower
                    yield result(ids, texts)
                    ids, texts, held = ids[-1:], texts[-1:], len(text)
            if not over and len(texts) > 1:
                yield result(ids, texts)
                ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
