"""Language identification: accuracy on languages made by rule, mixed texts, and the shortcut around Viterbi."""

import random
import zlib

import numpy as np
import pytest

from watchtide.llm import langid as L

SYLLABLES = {"aa": "ka lo mi nu ta ro", "bb": "sch tz ung ein keit der", "cc": "eau oux lle que ment", "ru": "да ко ми не то ра"}


def text(rnd, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(1)
    rows = [(k, text(rnd, lang, rnd.randint(3, 60)), lang) for k, lang in enumerate(["aa"] * 80 + ["bb"] * 60 + ["cc"] * 40 + ["ru"] * 20)] + [(1000, None, "aa"), (1001, "x", None), (1002, "", "bb")]
    return L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)


def predicted(spark, model, texts):
    df = spark.createDataFrame([(k, t, "zz", 0.5) for k, t in enumerate(texts)], "doc_id long, text string, lang string, score double")
    out = L.predict(df, model)
    assert out.columns == [*df.columns, "_lang"]
    return {r["doc_id"]: r["_lang"] for r in out.collect()}


def test_held_out_texts(spark, model):
    rnd = random.Random(2)
    langs = [rnd.choice(list(SYLLABLES)) for _ in range(200)]
    got = predicted(spark, model, [text(rnd, x, rnd.randint(3, 30)) for x in langs])
    assert model.langs == ["aa", "bb", "cc", "ru"]
    assert np.mean([got[k]["pred"] == x for k, x in enumerate(langs)]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_spans_of_mixed_text(spark, model):
    rnd = random.Random(3)
    a, b, c = text(rnd, "aa", 40), text(rnd, "ru", 20), text(rnd, "cc", 30)
    mixed = f"{a}. {b} -- {c}!"
    got = predicted(spark, model, [mixed])[0]
    spans = [(mixed[s["from"] : s["to"]], s["lang"]) for s in got["spans"]]
    assert spans == [(a, "aa"), (b, "ru"), (c, "cc")]
    sizes = {x: sum(ch.isalpha() for ch in t) for x, t in (("aa", a), ("ru", b), ("cc", c))}
    assert got["pred"] == max(sizes, key=sizes.get) and got["score"] < 0.8


def test_defined_cases(spark, model):
    got = predicted(spark, model, [None, "", "123 !?", "漢字", "́́", "KALO MITA", "kalo " * 50000, "a\x00b"])
    assert [(got[k]["pred"], got[k]["score"]) for k in (0, 1, 2, 4)] == [("und", 0.0)] * 4
    assert got[3]["pred"] in model.langs and got[3]["score"] < 0.5 and got[5]["pred"] == "aa" and got[6]["pred"] == "aa" and len(got[6]["spans"]) == 1
    nothing = L.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert predicted(spark, nothing, ["kalo"])[0]["pred"] == "und"
    assert L.predict(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_one_language_throughout_is_decided_as_by_viterbi(model):
    rnd = random.Random(4)
    texts = []
    for _ in range(150):
        parts = [text(rnd, rnd.choice(list(SYLLABLES)), rnd.choice([1, 2, 5, 20])) for _ in range(rnd.choice([1, 1, 2, 4]))]
        texts.append(" ".join(parts))
    words, labels, _ = model.label(texts)
    (pair, triple), whole = words.features()
    scores = np.add.reduceat(model.logs[pair] + model.logs[triple], words.shift).astype(np.float64) + model.logs[whole]
    can = model.scripts[words.script]
    scores = np.where(can, scores, scores.min(1, keepdims=True) - 10.0 * words.size[:, None])

    def value(path, s):
        return s[np.arange(len(path)), path].sum() - L.SWITCH * (np.diff(path) != 0).sum()

    for d in range(len(texts)):
        s = scores[words.doc == d]
        assert abs(value(labels[words.doc == d], s) - value(L.viterbi(s, L.SWITCH), s)) < 1e-6


def test_paths_without_the_language_of_the_whole_text_are_found():
    rng = np.random.default_rng(6)
    scores = [np.array([[0.0, -10.0, -8.0]] * 2 + [[-10.0, 0.0, -8.0]] * 2) + [[0, 0, 3.5]]]  # the third language is best throughout, the others gain 9 each
    scores += [rng.normal(size=(rng.integers(1, 8), 3)) * rng.choice([2, 4, 8]) for _ in range(300)]
    doc = np.repeat(np.arange(len(scores)), [len(s) for s in scores])
    cuts = np.searchsorted(doc, np.arange(len(scores)))
    best = np.array([s.sum(0).argmax() for s in scores])
    swept = set(L.Model(["a", "b", "c"], None, None)._may_switch(np.concatenate(scores), doc, best, cuts, np.arange(len(scores))).tolist())

    def value(path, s):
        return s[np.arange(len(path)), path].sum() - L.SWITCH * (np.diff(path) != 0).sum()

    missed = [d for d, s in enumerate(scores) if d not in swept and value(L.viterbi(s, L.SWITCH), s) > value(np.full(len(s), best[d]), s) + 1e-6]
    assert best[0] == 2 and missed == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    s = rng.normal(size=(6, 3)) * 4
    best = max(s[np.arange(6), p].sum() - 3.0 * (np.diff(p) != 0).sum() for p in np.stack(np.meshgrid(*[range(3)] * 6), -1).reshape(-1, 6))
    p = L.viterbi(s, 3.0)
    assert abs(s[np.arange(6), p].sum() - 3.0 * (np.diff(p) != 0).sum() - best) < 1e-9


def test_held_out_rows(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id")
    assert [r[0] for r in rows.select(L.held_out()).collect()] == [zlib.crc32(str(k).encode()) % 4 == 2 for k in range(50)]
