"""Benchmark windows against a scan word by word."""

import random
import re

import pytest
from pyspark.sql import functions as F

from watchtide.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n + 1, min(1, len(w)))):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item or "")
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture
def corpus(prose):
    rnd, make = prose(2, 30)
    items = [(f"i{k}", make(rnd.choice([3, 9, 10, 11, 25]))) for k in range(12)] + [("i3", make(12)), (None, make(15)), ("empty", ""), ("null", None), ("dup", "Zäh 1 zwei! drei")]
    docs = [(k, " ".join([make(rnd.randint(0, 30)), rnd.choice(items)[1] or "", make(rnd.randint(0, 30))]).replace(" ", rnd.choice([" ", ", ", "\n"]))) for k in range(60)]
    return docs + [(60, None), (61, ""), (62, "..."), (63, "zÄH zäh 1 ZWEI-drei"), (5, docs[5][1]), (None, docs[6][1]), (64, "x" * 20000)], items


@pytest.mark.parametrize("most", [500_000, 7])
def test_hits_equal_a_plain_scan(spark, corpus, monkeypatch, most):
    monkeypatch.setattr(D, "WINDOWS_PER_BLOCK", most)
    docs, items = corpus
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int").repartition(3)
    got = D.scan(df, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=str) == expected(docs, items)
    by_doc = dict(docs)
    for r in got:  # the spans hold the hit words
        raw = (by_doc[r["doc_id"]] or "").encode()
        assert sum(len(words(raw[s["from"] : s["to"]].decode())) for s in r["spans"]) == r["n_hit"]


def test_removal_leaves_no_window_and_no_clean_text_changes(spark, corpus):
    docs, items = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("window", F.lit(3))
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = D.remove(df, bench)
    assert out.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(left) == len(docs) and all(n == 0 for _, _, n, _ in expected(left, items))
    clean = {d for d, _, n, _ in expected(docs, items) if n == 0}
    assert {(d, t) for d, t in left if d in clean} == {(d, t) for d, t in docs if d in clean}
    kept = D.remove(df, bench, whole_documents=True).collect()
    assert {r["doc_id"] for r in kept} == clean


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("x", "a b")], "item_id string, text string")
    assert D.scan(docs.limit(0), bench).count() == 0 and D.scan(docs, bench.limit(0)).first()["n_hit"] == 0
    assert D.remove(docs, bench.limit(0)).first()["text"] == "a b"
