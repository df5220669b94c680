"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

Features: densities of lexicon words and of lexicon word beginnings, nearness of second-person words to them, capitals,
punctuation, and obfuscation (symbols for letters, stretched letters). The lexicon holds what is much more frequent
in toxic than in other labelled texts.

The fit uses at most about `SAMPLE` labelled rows. The features that the trees learn from are made with the lexicon of
the other half of the rows; the calibration is fitted on rows that the trees have not seen; scores use the
lexicon of all rows. Scores are made from the text alone.

Defined cases: null and empty texts have all features 0 and get the score of that; without labels of both kinds the
score is the share of toxic labels, or 0.5; repeated labels of a document count once, toxic if any says so; null labels are
left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from watchtide.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees
from watchtide.llm.langid import _tables
from watchtide.llm.text import U, mix, pick, steps

#: Labelled rows that a fit uses at most, about.
SAMPLE = 20_000
#: Letters of the word beginnings that the lexicon also holds.
STEMS = (4, 5)
NEAR = 5  # words
#: Second-person words of the languages at hand.
SECOND_PERSON = ["you", "your", "yours", "yourself", "yourselves", "u", "ur", "du", "dich", "dir", "dein", "deine", "deinen", "ihr", "euch", "euer", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros"]
#: Symbols written for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "u", "€": "e", "|": "l"}
_POWER = mix(np.arange(1, 257, dtype=np.uint64)) | U(1)
WIDTH = 22


class Terms:
    """Words (runs of letters) of a batch of texts, with numbers of the lower-case word and of its beginnings."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray):
        letter, inside, lower = _tables()
        known = np.minimum(points, len(letter) - 1)
        self.is_letter = letter[known]
        word = inside[known]
        cut = np.zeros(len(points) + 1, bool)
        cut[offsets] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | cut[1:-1]
        last[:-1] &= ~word[1:] | cut[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.size = self.end - self.start
        shift = np.cumsum(self.size) - self.size
        at = np.arange(int(self.size.sum())) + np.repeat(self.start - shift, self.size)
        self.inner = np.arange(len(at)) - np.repeat(shift, self.size)
        self.low = lower[known[at]].astype(np.uint64)
        self.changed = (self.low != known[at]) & letter[known[at]]  # capitals, where letters have two forms
        self.shift, self.at = shift, at
        values = mix(self.low + U(7)) * _POWER[self.inner & 255]
        total = lambda v: np.add.reduceat(v, shift) if len(shift) else v[:0]
        self.word = mix(total(values))
        self.stems = [np.where(self.size >= k, mix(total(values * (self.inner < k)) + U(k)), U(0)) for k in STEMS]


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def number_of(word: str) -> int:
    return int(Terms(*points_of([word])).word[0])


@dataclass
class Lexicon:
    """Numbers, in order, and weights of words and of beginnings."""

    words: np.ndarray
    word_weight: np.ndarray
    stems: np.ndarray
    stem_weight: np.ndarray
    second: np.ndarray

    @staticmethod
    def _of(numbers: np.ndarray, known: np.ndarray, weight: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(numbers))
        place = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
        return np.where(known[place] == numbers, weight[place], 0.0)


def features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    points, offsets = points_of(texts)
    n = len(texts)
    terms = Terms(points, offsets)
    length = np.maximum(np.diff(offsets), 1)
    words = np.bincount(terms.doc, minlength=n)
    some = np.maximum(words, 1)
    per = lambda doc, v=None: np.bincount(doc, v, n)
    out = np.zeros((n, WIDTH))

    def most(doc: np.ndarray, v: np.ndarray) -> np.ndarray:
        best = np.zeros(n)
        np.maximum.at(best, doc, v)
        return best

    weight = lexicon._of(terms.word, lexicon.words, lexicon.word_weight)
    stem = np.maximum.reduce([lexicon._of(s, lexicon.stems, lexicon.stem_weight) for s in terms.stems])
    either = np.maximum(weight, stem)
    for k, w in enumerate((weight, stem, either)):
        hit = w > 0
        out[:, 4 * k] = np.log1p(per(terms.doc[hit]))
        out[:, 4 * k + 1] = per(terms.doc[hit]) / some
        out[:, 4 * k + 2] = per(terms.doc[hit], w[hit]) / some
        out[:, 4 * k + 3] = most(terms.doc[hit], w[hit])
    second = np.isin(terms.word, lexicon.second)
    out[:, 12] = per(terms.doc[second]) / some
    at, hit = np.flatnonzero(second), np.flatnonzero(either > 0)
    if len(at) and len(hit):
        place = np.searchsorted(at, hit)
        for side, there in ((place - 1, place > 0), (place, place < len(at))):
            near = at[np.clip(side, 0, len(at) - 1)]
            close = there & (np.abs(near - hit) <= NEAR) & (terms.doc[near] == terms.doc[hit])
            out[:, 13] += per(terms.doc[hit[close]]) / some
    owner = np.repeat(terms.doc, terms.size)
    letters = np.maximum(per(owner), 1)
    out[:, 14] = per(owner[terms.changed]) / letters
    if len(terms.shift):
        loud = (np.add.reduceat(terms.changed.astype(np.int64), terms.shift) == terms.size) & (terms.size >= 3)
        out[:, 15] = per(terms.doc[loud]) / some
        stretched = np.zeros(len(terms.low), bool)
        stretched[2:] = (terms.low[2:] == terms.low[1:-1]) & (terms.low[2:] == terms.low[:-2]) & (terms.inner[2:] >= 2)
        out[:, 16] = per(owner[stretched]) / some
    whose = np.searchsorted(offsets, np.arange(len(points)), "right") - 1 if len(points) else np.zeros(0, np.int64)
    for k, mark in ((17, "!"), (18, "?")):
        out[:, k] = per(whose[points == ord(mark)]) / length
    visible = ~terms.is_letter & (points > 32) & ~((points >= 48) & (points <= 57))
    out[:, 19] = per(whose[visible]) / length
    # symbols between letters of one text, read as the letters they stand for
    table = np.arange(0x2100, dtype=np.uint32)
    for symbol, meant in LOOKALIKES.items():
        table[ord(symbol)] = ord(meant)
    small = points < len(table)
    meant = np.where(small, table[np.where(small, points, 0)], points)
    between = np.zeros(len(points), bool)
    if len(points) > 2:
        solid = terms.is_letter | (meant != points)
        between[1:-1] = (meant != points)[1:-1] & solid[:-2] & solid[2:] & (whose[:-2] == whose[2:])
        between[1:-1] &= terms.is_letter[:-2] | terms.is_letter[2:]
    if between.any():
        out[:, 20] = per(whose[between]) / some
        read = Terms(np.where(between, meant, points), offsets)
        disguised = np.add.reduceat(np.append(between, False).astype(np.int64), np.stack([read.start, read.end], 1).ravel())[::2] > 0
        found = disguised & (lexicon._of(read.word, lexicon.words, lexicon.word_weight) > 0)
        out[:, 21] = np.log1p(per(read.doc[found]))
    return out


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    calibrate: Isotonic

    def score(self, texts: list[str]) -> np.ndarray:
        return np.clip(self.calibrate(self.trees.margin(features(texts, self.lexicon))), 0, 1)


def _fit_lexicons(rows: DataFrame) -> list[Lexicon]:
    """From (text, toxic, fold): what is more frequent in toxic texts, beyond chance, in fold 0, in fold 1 and in both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in steps(batches, limit=1 << 20):
            kind = (np.array(batch.column("toxic").to_pylist()) > 0) + 2 * np.array(batch.column("fold").to_pylist())
            terms = Terms(*points_of([x or "" for x in batch.column("text").to_pylist()]))
            for stem, numbers in enumerate([terms.word, *terms.stems]):
                real = numbers != 0
                once = np.unique(np.stack([terms.doc[real].astype(np.uint64), numbers[real]], 1), axis=0)
                found.append(np.stack([once[:, 1], (4 * min(stem, 1) + kind[once[:, 0].astype(np.int64)]).astype(np.uint64)], 1))
        if found:
            each, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(each[:, 0].copy().view(np.int64)), pa.array(each[:, 1].astype(np.int32)), pa.array(n, pa.int64())], names=["term", "kind", "n"])

    totals = np.zeros((2, 2))
    for r in rows.groupBy("fold", (F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect():
        totals[r["fold"], r["toxic"]] = r["n"]
    counts = rows.mapInArrow(count, "term long, kind int, n long").groupBy("term", F.expr("kind div 4 AS stem")).agg(*[F.sum(F.when(F.col("kind") % 4 == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)])
    few = counts.where("n1 + n3 >= 3").toArrow()
    number, stem = few["term"].to_numpy().view(np.uint64), few["stem"].to_numpy()
    by_fold = np.array([[few["n0"].to_numpy(), few["n1"].to_numpy()], [few["n2"].to_numpy(), few["n3"].to_numpy()]], float)
    second = np.array([number_of(x) for x in SECOND_PERSON], np.uint64)
    out = []
    for folds in ([0], [1], [0, 1]):
        no, yes = by_fold[folds].sum(0)
        clean, toxic = np.maximum(totals[folds].sum(0), 1)
        weight = np.log(np.maximum(yes - np.sqrt(yes), 0.1) / toxic * clean / (no + np.sqrt(no) + 0.5))
        parts = []
        for kind in (0, 1):
            keep = (stem == kind) & (yes >= 3) & (weight > np.log(4))
            order = np.argsort(number[keep])
            parts += [number[keep][order], weight[keep][order]]
        out.append(Lexicon(*parts, second))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from (doc_id, text) and (doc_id, toxic)."""
    known = pick(labels, doc_id="long", toxic="int").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    share = int((1 << 20) * min(1.0, sample / max(total, 1)))
    draw = lambda seed, n: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n)).cast("int")
    chosen = F.broadcast(known.where(draw(6, 1 << 20) < share))  # about `sample` rows of 12 bytes
    rows = pick(docs, doc_id="long", text="string").join(chosen, "doc_id").withColumns({"fold": draw(8, 2), "part": draw(9, 5)})
    lexicons = _fit_lexicons(rows.select("text", "toxic", "fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=1 << 20):
            for fold in (0, 1):
                mine = batch.filter(pa.array([x == fold for x in batch.column("fold").to_pylist()]))
                x = features([t or "" for t in mine.column("text").to_pylist()], lexicons[1 - fold])
                yield pa.RecordBatch.from_arrays([mine.column("doc_id"), mine.column("toxic"), mine.column("part"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "toxic", "part", "x"])

    table = rows.select("doc_id", "text", "toxic", "fold", "part").mapInArrow(run, "doc_id long, toxic int, part int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(table["x"].combine_chunks().flatten()).reshape(-1, WIDTH)
    y, learn = (table["toxic"].to_numpy() > 0).astype(float), table["part"].to_numpy() > 0
    trees = fit_trees(x[learn], y[learn])
    return Model(lexicons[2], trees, fit_isotonic(trees.margin(x[~learn]), y[~learn]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with all their columns, and `_toxicity` (0 to 1), which replaces a column of that name."""
    docs = docs.drop("_toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=1 << 20):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(texts))], names=[*batch.schema.names, "_toxicity"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_toxicity", T.DoubleType())]))
