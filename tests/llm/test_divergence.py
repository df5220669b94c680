"""The audit against plain arithmetic, and skybands against all comparisons."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from watchtide.llm import divergence as D


def expected(rows, top=200):
    by, docs = {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        by.setdefault(lang, {}).setdefault(source, Counter()).update(words)
        docs.setdefault(lang, Counter()).update(set(words))
    out = []
    for lang, groups in by.items():
        kept = [t for t, d in docs[lang].items() if d >= 3]
        shares = {}
        for key, count in [*((s, c) for s, c in groups.items()), (None, sum(groups.values(), Counter()))]:
            total = sum(count[t] for t in kept) + len(kept)
            shares[key] = {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}
        gap = lambda p, q: (p - q) ** 2 // q
        ranked = lambda found: sorted(found, key=lambda x: (-x[1], x[0].encode()))
        for s in groups:
            pairs = [(o, sum(gap(shares[s][t], shares[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, gap(shares[s][t], shares[None][t])) for t in kept if groups[s][t] and shares[s][t] > shares[None][t]]
            out += [(lang, s, "pair", i, v, r) for r, (i, v) in enumerate(ranked(pairs), 1)]
            out += [(lang, s, "term", i, v, r) for r, (i, v) in enumerate(ranked(terms)[:top], 1)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n long, term string").repartition(5)
    return sorted(map(tuple, D.audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("k", [1, 3, 20])
def test_skyband(k):
    rng = np.random.default_rng(k)
    for m in (0, 1, 50, 1500):
        n, low, term = rng.integers(1, 9, m), rng.integers(1, 30, m), rng.permutation(m)
        order = np.lexsort((term, low, -n))
        n, low, term = n[order], low[order], term[order]
        above = ((n[None, :] >= n[:, None]) & (low[None, :] <= low[:, None]) & (term[None, :] < term[:, None])).sum(1)
        assert (D.skyband(n, low, term, k) == (above < k)).all()


def test_audit(spark, prose):
    rnd, make = prose(9, 150)
    rows = [(rnd.choice(["en", "en", "de"]), rnd.choice(["a", "b", "é", "Z"]), make(rnd.randint(0, 60)).title()) for _ in range(120)]
    rows += rows[:4] + [(None, None, "Alpha beta Ünï"), (None, "", None), ("", "x", "alpha"), ("", "y", "ALPHA beta"), ("none", "p", "7 8"), ("none", "q", ""), ("solo", "p", "one one one")]
    assert run(spark, rows) == expected(rows)
    assert run(spark, rows, top=7) == expected(rows, 7)


def test_small_steps_give_the_same(spark, prose):
    rnd, make = prose(10, 300)
    rows = [("en", f"s{rnd.randint(0, 9)}", make(40)) for _ in range(150)] + [("en", "hot", make(200)) for _ in range(100)]
    assert run(spark, rows, top=10, chunk_terms=32, tile_sources=3, most=50) == expected(rows, 10)
    df = spark.createDataFrame([(*r,) for r in rows], "lang string, source string, text string")
    count = lambda **k: sorted(map(tuple, D.counted(df, **k).groupBy("source", "term").agg({"n": "sum", "docs": "sum"}).collect()))
    assert count(long=100) == count()


def test_shares_are_exact(spark):
    n, total = 8_999_999_999_999_999_990, 9_223_372_036_854_775_807
    got = spark.range(1).select(D.share(D.F.lit(n), D.F.lit(total)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 1) // total


def test_empty(spark):
    assert run(spark, []) == []
