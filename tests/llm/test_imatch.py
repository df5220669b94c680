"""I-Match: edited texts by hand, frequencies by hand, likeness of copies and strangers."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa

from watchtide.llm import imatch as I
from watchtide.llm.text import Words, as_bytes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def as_column(texts):
    return as_bytes(pa.array([t.encode() for t in texts], pa.large_binary()))


def corpus(prose):
    rnd, make = prose(7, 2000)
    texts = [make(int(rnd.expovariate(1 / 90))) for _ in range(250)]
    return [(k, t) for k, t in enumerate(texts)] + [(300, texts[5]), (301, None), (302, ""), (303, "!!!"), (304, "ab"), (305, "é" * 10), (-7, "some words here"), (None, "no name"), (306, make(20000))]


def test_lexicon_holds_the_band(spark, prose):
    rows = corpus(prose)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, term int").repartition(3)
    counts = collections.Counter(w for _, t in rows for w in set(WORD.findall((t or "").lower())))
    got = I.fit(df, 0.02, 0.1)
    band = [w for w, n in counts.items() if 0.02 * len(rows) <= n <= 0.1 * len(rows)]
    assert len(got) == len(band) > 50 and set(Words(*as_column(band)).hashes().tolist()) == set(got.tolist())
    assert len(I.fit(df.limit(0))) == 0


def test_edited_texts(spark, prose):
    rows = corpus(prose)
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, part int").repartition(4)
    got = {r["doc_id"]: r for r in I.edited(df, I.fit(df)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    prints = I.Prints(*as_column([t or "" for _, t in order]), I.fit(df))
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        want = text[: len(text) - third] + after[:third]
        assert got[doc]["n_chars"] == len(text) and got[doc]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[doc]["fingerprint"] == prints.texts()[k]
        assert 0 <= got[doc]["near_edited"] <= 1 and 0 <= got[doc]["near_next"] <= 1
    assert got[5]["fingerprint"] == got[300]["fingerprint"] and got[301]["fingerprint"] == got[302]["fingerprint"] == "empty"
    near = np.array([[r["near_edited"], r["near_next"]] for r in got.values() if r["n_chars"] > 300])
    assert near[:, 0].mean() > 0.25 and near[:, 1].mean() < 0.05 and (near[:, 0] > near[:, 1]).mean() > 0.97
    assert I.edited(df.limit(0), I.fit(df)).count() == 0
    assert I.edited(df.where("doc_id = 1"), I.fit(df)).count() == 1


def test_any_number_of_parts(spark):
    """Every part is a task of its own and holds its rows in order and its follower."""
    rows = [(k * 37 % 9001, f"text {k}") for k in range(9001)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        got = I.in_order(df).select("part", "spare", "doc_id", I.F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    parts, tasks = {}, collections.defaultdict(set)
    for r in got:
        parts.setdefault(r["part"], []).append((r["spare"], r["doc_id"]))
        tasks[r["task"]].add(r["part"])
    assert len(parts) > 1000 and all(len(x) == 1 for x in tasks.values())
    sizes = sorted(map(len, parts.values()))
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2] and len(got) == len(rows) + len(parts)
    order = [d for k in sorted(parts) for s, d in parts[k] if not s]
    assert order == sorted(order, reverse=True) and all(parts[k][-1][0] == 1 for k in parts)
    keys = sorted(parts)
    assert [parts[k][-1][1] for k in keys] == [parts[k][0][1] for k in keys[1:] + keys[:1]]


def test_equal_ids_and_texts(spark):
    rows = [(k // 3, "abcdef"[: k % 5] * 4) for k in range(30)] + [(9, "abc" * 4)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = I.edited(df, I.fit(df)).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in got) == sorted((d, len(t)) for d, t in rows)


def test_likeness_falls_with_the_share_of_changed_terms(prose):
    rnd, make = prose(8, 5000)
    base = make(400).split()
    means = []
    for share in (0.0, 0.1, 0.3, 0.6, 1.0):
        others = [" ".join(w if rnd.random() >= share else make(1) for w in base) for _ in range(60)]
        own = I.Prints(*as_column([" ".join(base)] * 60), np.zeros(0, np.uint64))
        means.append(own.likeness(I.Prints(*as_column(others), np.zeros(0, np.uint64))).mean())
    assert means[0] == 1 and all(a > b for a, b in zip(means, means[1:])) and means[-1] < 0.1
