"""Near-duplicates against all pairs."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from watchtide.llm import dartminhash as D
from watchtide.llm.text import as_bytes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    words = WORD.findall((text or "").lower())
    return collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else collections.Counter({("=", text or ""): 1})


def classes(rows, weighted=False, least=0.8):
    bags = [(i, bag(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x) in enumerate(bags):
        for j, y in bags[:k]:
            both, either = (x & y, x | y) if weighted else (set(x) & set(y), set(x) | set(y))
            n, m = (sum(both.values()), sum(either.values())) if weighted else (len(both), len(either))
            if n >= least * m:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def edited(rnd, text, edits, make):
    words = text.split()
    for _ in range(edits):
        at = rnd.randrange(len(words))
        words[at : at + rnd.randint(0, 2)] = make(rnd.randint(0, 2)).split()
    return " ".join(words)


@pytest.mark.parametrize("weighted", [False, True])
def test_classes_of_a_large_group_of_copies_at_any_distance(spark, prose, monkeypatch, weighted):
    monkeypatch.setattr(D, "BLOCK", 32)
    rnd, make = prose(1)
    base = make(140)
    texts = [edited(rnd, base, rnd.randint(0, 9), make) for _ in range(110)]
    texts += [" ".join(base.split()[: 140 - 3 * k]) for k in range(20)]  # cut ends: alike among themselves
    line = make(12)
    texts += [" ".join([line] * k) for k in (2, 3, 6, 7)] + [make(100) for _ in range(20)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["class_id"] for r in D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), weighted=weighted).collect()}
    assert got == classes(rows, weighted)


def test_defined_cases(spark):
    rows = [(1, "one two"), (2, "One, two!"), (3, None), (4, ""), (5, "!!!"), (6, "!!!"), (7, "???"), (8, "x " * 5000), (9, "x " * 9), (10, "a b c d e"), (10, "a b c d e"), (None, "one two"), (None, None)]
    df = spark.createDataFrame([(*r, "en", i) for i, r in enumerate(rows)], "doc_id long, text string, class_id string, key int")
    got = sorted(((r["doc_id"], r["class_id"]) for r in D.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (8, 8), (9, 8), (10, 10), (10, 10), (None, None), (None, None)], key=str)
    assert D.near_duplicates(df.limit(0)).collect() == []


def test_signatures_agree_as_often_as_weighted_sets_are_alike():
    rng = np.random.default_rng(3)
    element = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for share in (0.2, 0.5, 0.9):
        x, y = rng.uniform(0.1, 4, 300), rng.uniform(0.1, 4, 300)
        same = rng.random(300) < share
        y[same] = x[same]
        k = 4096
        found = D.signatures(np.array([0, 300, 600]), np.concatenate([element, element]), np.concatenate([x, y]), k)
        assert abs((found[0] == found[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04
    assert (D.signatures(np.array([0, 1]), element[:1], np.array([1e-3]), 64) != 0).all()


def test_shingles_stay_within_a_text():
    texts = ["a b c d e f", "", "g h", "!!", "i j k l m"]
    cuts, element, counts = D.shingle_sets(*as_bytes(pa.array(texts)))
    assert np.diff(cuts).tolist() == [2, 0, 1, 1, 1] and len(set(element.tolist())) == 5 and counts.sum() == 5
