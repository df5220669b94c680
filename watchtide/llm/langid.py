"""Language identification of mixed-language text.

The script of a word narrows the candidate languages; each candidate scores the word by a naive
Bayes model over its letter pairs, letter triples and the word itself; Viterbi over the words, with a penalty per
change of language, labels spans. A document's language has the most letters in its spans.

The model is fitted on a bounded sample of labelled rows (`per_language`); prediction sees the text only.

Defined cases: null and letter-less texts are `und` with score 0; if no learned language uses a
word's script, the word counts the same for all; ties go to the language with more rows, then by
name; without labelled rows everything is `und`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from watchtide.llm.text import U, mix, pick, steps

BUCKETS = 1 << 17
#: Cost, in natural-log units, of a change of language between two words.
SWITCH = 15.0
#: First code point of each script block that narrows candidates; from one to the next is one script.
SCRIPTS = {
    0x0: "latin", 0x370: "greek", 0x400: "cyrillic", 0x530: "armenian", 0x590: "hebrew", 0x600: "arabic", 0x700: "other", 0x900: "devanagari", 0x980: "bengali", 0xA00: "gurmukhi",
    0xA80: "gujarati", 0xB00: "oriya", 0xB80: "tamil", 0xC00: "telugu", 0xC80: "kannada", 0xD00: "malayalam", 0xD80: "sinhala", 0xE00: "thai", 0xE80: "lao", 0xF00: "tibetan", 0x1000: "myanmar",
    0x10A0: "georgian", 0x1100: "hangul", 0x1200: "ethiopic", 0x13A0: "other", 0x1780: "khmer", 0x1800: "mongolian", 0x18B0: "other", 0x1E00: "latin", 0x1F00: "greek", 0x2000: "other",
    0x2C60: "latin", 0x2C80: "other", 0x3040: "hiragana", 0x30A0: "katakana", 0x3100: "other", 0x3400: "han", 0xA000: "other", 0xA720: "latin", 0xA800: "other", 0xAC00: "hangul", 0xD7B0: "other",
    0xF900: "han", 0xFB00: "other", 0xFB50: "arabic", 0xFE00: "other", 0x20000: "han",
}
_SCRIPT_AT = np.array(list(SCRIPTS))
_SCRIPT_NAMES = sorted(set(SCRIPTS.values()))
_SCRIPT_ID = np.array([_SCRIPT_NAMES.index(x) for x in SCRIPTS.values()])
_TOP = 0x40000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter, does it go on with a word, its lower-case form."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(_TOP)]
    letter = np.array([k == "L" for k in kinds] + [False])
    mark = np.array([k == "M" for k in kinds] + [False])
    lower = np.arange(_TOP + 1, dtype=np.uint32)
    for i in range(0x1FFFF):
        small = chr(i).lower()
        if len(small) == 1:
            lower[i] = ord(small)
    return letter, letter | mark, lower


class LetterWords:
    """Runs of letters (and marks after them) in a batch of texts, by code point."""

    def __init__(self, texts: list[str]):
        letter, inside, lower = _tables()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        points = np.minimum(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), _TOP)
        cut = np.zeros(len(points) + 1, bool)
        cut[self.offsets] = True
        word = inside[points]
        first = word.copy()
        first[1:] &= ~word[:-1] | cut[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | cut[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        letters_before = np.concatenate([[0], np.cumsum(letter[points])])
        real = letters_before[end] > letters_before[start]  # not marks alone
        self.start, self.end = start[real], end[real]
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        size = self.end - self.start
        self.shift = np.cumsum(size) - size
        self.size = size
        at = np.arange(int(size.sum())) + np.repeat(self.start - self.shift, size)
        self.letters = lower[points[at]].astype(np.uint64)
        self.script = _SCRIPT_ID[np.searchsorted(_SCRIPT_AT, points[self.start], "right") - 1]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each letter's pair and triple (to the left, with a border before the first), and of each word."""
        c = self.letters
        one, two = np.zeros_like(c), np.zeros_like(c)
        one[1:], two[2:] = c[:-1], c[:-2]
        one[self.shift] = two[self.shift] = 1
        second = (self.shift + 1)[self.size > 1]
        two[second] = 1
        ends = np.zeros_like(c)
        ends[self.shift + self.size - 1] = 1
        pair = mix(c * U(0x9E3779B97F4A7C15) + one * U(2) + U(1)) % U(BUCKETS)
        triple = mix(c * U(0x9E3779B97F4A7C15) + one * U(0xC2B2AE3D27D4EB4F) + two * U(0x165667B19E3779F9) + ends) % U(BUCKETS)
        inner = np.arange(len(c)) - np.repeat(self.shift, self.size)
        powers = mix(np.arange(64, dtype=np.uint64) + U(11)) | U(1)
        word = mix(np.add.reduceat(c * powers[inner & 63], self.shift)) % U(BUCKETS) if len(c) else c
        return np.stack([pair, triple]).astype(np.int64), word.astype(np.int64)


@dataclass
class Model:
    langs: list[str]  # more rows first
    logs: np.ndarray  # bucket x language
    scripts: np.ndarray  # script x language: can it be

    def label(self, texts: list[str]) -> tuple[LetterWords, np.ndarray, np.ndarray]:
        """The words, each word's language after Viterbi, and each text's total score by language."""
        words = LetterWords(texts)
        n = len(words.start)
        if not n:
            return words, np.zeros(0, np.int64), np.zeros((len(texts), len(self.langs)))
        (pair, triple), whole = words.features()
        scores = np.add.reduceat(self.logs[pair] + self.logs[triple], words.shift).astype(np.float64) + self.logs[whole]
        can = self.scripts[words.script]
        scores = np.where(can, scores, scores.min(1, keepdims=True) - 10.0 * words.size[:, None])
        scores[~can.any(1)] = 0
        cuts = np.searchsorted(words.doc, np.arange(len(texts)))
        full = np.flatnonzero(np.bincount(words.doc, minlength=len(texts)))
        totals = np.zeros((len(texts), len(self.langs)))
        totals[full] = np.add.reduceat(scores, cuts[full])
        best = totals.argmax(1)
        labels = best[words.doc]
        for d in self._may_switch(scores, words.doc, best, cuts[full], full):
            to = cuts[d + 1] if d + 1 < len(texts) else n
            labels[cuts[d] : to] = viterbi(scores[cuts[d] : to], SWITCH)
        return words, labels, totals

    def _may_switch(self, scores: np.ndarray, doc: np.ndarray, best: np.ndarray, cuts: np.ndarray, full: np.ndarray) -> np.ndarray:
        """Texts for which one language throughout may not be the best path.

        Gains are over the best language. Let no run in one language gain more than the penalty. A path with a run in the best
        language pays a penalty at least for each other run, so it gains nothing. One without pays for all runs but one; its first run is
        a prefix and its last a suffix, so it pays only if a prefix and a suffix together gain more than the penalty.
        """
        own = scores[np.arange(len(doc)), best[doc]]
        gain, head, tail = np.zeros((3, len(full)))
        last = np.append(cuts[1:], len(doc)) - 1
        for k in range(scores.shape[1]):
            step = scores[:, k] - own
            total = np.cumsum(step)
            before = total - step
            far = (np.ptp(total) + 1.0) * 2 * doc  # each text starts below all before it
            low = np.minimum.accumulate(before - far)
            gain = np.maximum(gain, np.maximum.reduceat(total - far - low, cuts))
            head = np.maximum(head, np.maximum.reduceat(total, cuts) - before[cuts])
            tail = np.maximum(tail, total[last] - np.minimum.reduceat(before, cuts))
        return full[np.maximum(gain, head + tail) > SWITCH - 1e-3]


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each row; a change of label costs `switch`."""
    n, k = scores.shape
    back = np.zeros((n, k), np.int32)
    value = scores[0].copy()
    same = np.arange(k)
    for t in range(1, n):
        top = int(value.argmax())
        stay = value >= value[top] - switch
        back[t] = np.where(stay, same, top)
        value = np.where(stay, value, value[top] - switch) + scores[t]
    out = np.empty(n, np.int64)
    out[-1] = value.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def fit(labelled: DataFrame, per_language: int = 1000) -> Model:
    """Model from (doc_id, text, lang); about `per_language` rows of each language are used, or all if there are fewer."""
    rows = pick(labelled, doc_id="long", text="string", lang="string").where("lang IS NOT NULL")
    counts = sorted(((r["n"], r["lang"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[0], x[1]))
    langs = [x for _, x in counts]
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(_SCRIPT_NAMES), 0), bool))
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20))
    share = F.element_at(F.create_map(*[F.lit(v) for n, x in counts for v in (x, int((1 << 20) * min(1.0, per_language / n)))]), F.col("lang"))
    index = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in steps(batches, limit=1 << 20):
            codes = np.array([index[x] for x in batch.column("lang").to_pylist()])
            words = LetterWords([x or "" for x in batch.column("text").to_pylist()])
            (pair, triple), whole = words.features()
            lang = codes[words.doc]
            by_letter = np.repeat(lang, words.size)
            for k in np.unique(lang):
                found = np.bincount(np.concatenate([pair[by_letter == k], triple[by_letter == k], whole[lang == k]]), minlength=BUCKETS)
                scripts = np.bincount(words.script[lang == k], minlength=len(_SCRIPT_NAMES))
                total[k] = total.get(k, 0) + np.concatenate([found, scripts])
        for k, found in total.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], names=["lang", "bucket", "n"])

    found = rows.where(place < share).mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((BUCKETS + len(_SCRIPT_NAMES), len(langs)))
    table[found["bucket"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    logs = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(langs, logs, scripts > 0.001 * scripts.sum(0))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with all their columns, and a struct `_lang`: pred, score, spans (from, to in code points, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("from", pa.int64()), ("to", pa.int64()), ("lang", pa.string())])
    kind = pa.struct([("pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"], object)
        for batch in steps(batches, limit=1 << 20):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            n, k = len(texts), len(model.langs)
            if not k:
                out = [{"pred": "und", "score": 0.0, "spans": []}] * n
            else:
                words, labels, totals = model.label(texts)
                mass = np.bincount(words.doc * k + labels, words.size, n * k).reshape(n, k)
                letters = mass.sum(1)
                # of languages with equally many letters the better total, then the more frequent one
                order = np.lexsort((np.broadcast_to(np.arange(k), (n, k)), -totals, -mass))[:, 0]
                count = np.maximum(np.bincount(words.doc, minlength=n), 1)[:, None]
                odds = np.exp((totals - totals.max(1, keepdims=True)) / np.sqrt(count))
                sure = odds / odds.sum(1, keepdims=True)
                pred = np.where(letters > 0, order, k)
                score = np.where(letters > 0, mass[np.arange(n), order] / np.maximum(letters, 1) * sure.max(1), 0.0)
                new = np.ones(len(labels), bool)
                new[1:] = (labels[1:] != labels[:-1]) | (words.doc[1:] != words.doc[:-1])
                at = np.flatnonzero(new)
                to = np.concatenate([at[1:], [len(labels)]]) - 1 if len(at) else at
                spans: list[list] = [[] for _ in range(n)]
                for i, j in zip(at.tolist(), to.tolist()):
                    d = int(words.doc[i])
                    spans[d].append({"from": int(words.start[i] - words.offsets[d]), "to": int(words.end[j] - words.offsets[d]), "lang": names[labels[i]]})
                out = [{"pred": names[p], "score": float(s), "spans": x} for p, s, x in zip(pred, score, spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "_lang"])

    found = T.StructType.fromDDL("_lang struct<pred:string,score:double,spans:array<struct<from:bigint,to:bigint,lang:string>>>")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *found.fields]))


def held_out(doc_id: str = "doc_id") -> Column:
    """The quarter of documents that no label is learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2
