"""Rollups: any order, repeats, cut-off commits and compaction give the sums of what is there."""

import collections
import os
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from watchtide.llm import token_rollup as R

PATH = public_tokenizers.path("byte_bpe_50k.json")


def as_dict(df):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in df.collect()}


def test_counts(spark, prose):
    rnd, make = prose(9)
    rows = [(k, rnd.choice(["s", "t", None]), rnd.choice(["en", None]), make(rnd.randint(0, 50)) + "  x") for k in range(60)] + [(90, "s", "en", None), (3, "s", "en", "again"), (None, "s", "en", "a b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, lang string, text string, tokens int").repartition(3)
    squeeze = lambda t: " ".join(t.split())
    got = R.count(df, {"bpe": PATH, "words": "words"}, squeeze).collect()
    encode = Tokenizer.from_file(PATH).encode
    size = lambda t: len(encode(t, add_special_tokens=False).ids)
    want = [(d, s, x, "bpe", size(t or ""), size(squeeze(t or ""))) for d, s, x, t in rows] + [(d, s, x, "words", len((t or "").split()), len((t or "").split())) for d, s, x, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_batches(spark, tmp_path):
    folder, rnd = f"{tmp_path}/r", random.Random(1)
    names = "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_revised long"
    state, batches = {}, []
    for _ in range(6):
        add = [(rnd.randrange(10**9), "hot" if rnd.random() < 0.6 else rnd.choice(["a", None]), rnd.choice(["en", "de"]), rnd.choice(["v1", "v2"]), rnd.randint(0, 9), 0) for _ in range(40)]
        gone = rnd.sample(sorted(state), min(len(state), 10))
        deleted = [(d, *state.pop(d), 0) for d in gone]
        changed = [(d, *state[d], rnd.randint(0, 9)) for d in rnd.sample(sorted(state), min(len(state), 10))]
        for d, s, x, v, _, new in changed:
            state[d] = (s, x, v, new)
        state |= {d: (s, x, v, n) for d, s, x, v, n, _ in add}
        frame = lambda rows: spark.createDataFrame(rows, names)
        batches.append(R.inserted(frame(add)).unionByName(R.deleted(frame(deleted))).unionByName(R.revised(frame(changed))))
    order = [2, 0, 1, 0, 5, 3, 2, 4, 4]
    assert [R.commit(batches[k], folder, k) for k in order] == [True, True, True, False, True, True, False, True, False]
    want = collections.defaultdict(lambda: [0, 0])
    for s, x, v, n in state.values():
        want[s, x, v][0] += 1
        want[s, x, v][1] += n
    want = {k: tuple(v) for k, v in want.items()}
    assert as_dict(R.totals(spark, folder)) == want
    assert R.compact(spark, folder) == 5 and R.compact(spark, folder) == 5
    assert as_dict(R.totals(spark, folder)) == want
    assert not R.commit(batches[1], folder, 1)
    R.commit(batches[0].limit(0), folder, 8)
    assert as_dict(R.totals(spark, folder)) == want
    with pytest.raises(ValueError):
        R.compact(spark, folder)
        R.commit(batches[0], folder, 7)


def test_a_cut_off_commit_does_not_count(spark, tmp_path):
    folder = f"{tmp_path}/r"
    one = spark.createDataFrame([("s", "en", "v", 1, 5)], "source string, lang string, tokenizer string, documents long, tokens long")
    assert R.totals(spark, folder).count() == 0 and R.compact(spark, folder) is None
    R.commit(one, folder, 1)
    os.rename(f"{folder}/batch-1/_SUCCESS", f"{tmp_path}/moved")
    assert R.totals(spark, folder).count() == 0
    assert R.commit(one, folder, 1) and as_dict(R.totals(spark, folder)) == {("s", "en", "v"): (1, 5)}
    R.commit(one.selectExpr("source", "lang", "tokenizer", "-documents AS documents", "-tokens AS tokens"), folder, 2)
    assert R.totals(spark, folder).count() == 0
