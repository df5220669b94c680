"""Toxicity: trees and calibration on known functions, held-out accuracy, defined cases."""

import random

import numpy as np
import pytest

from watchtide.llm import boosting as B, toxicity as T
from watchtide.llm.langid import _tables


def auc(score, y):
    a, b = score[y == 1], score[y == 0]
    return np.mean((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None]))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = B.fit_trees(x[:3000], y[:3000])
    assert auc(trees.margin(x[3000:]), y[3000:]) > 0.98
    assert len(B.fit_trees(x, np.zeros(4000)).feature) == 0
    assert B.fit_trees(x[:0], y[:0]).margin(x[:3]).tolist() == [0, 0, 0]


def test_isotonic_equals_minimal_squares():
    rng = np.random.default_rng(2)
    margin = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * margin))).astype(float)
    found = B.fit_isotonic(margin, y)
    order = np.argsort(margin)
    s = np.concatenate([[0], np.cumsum(y[order])])
    want = [max(min((s[j] - s[i]) / (j - i) for j in range(k + 1, 301)) for i in range(k + 1)) for k in range(300)]  # min-max formula
    assert np.allclose(sorted(set(np.round(found.value, 9))), sorted(set(np.round(want, 9))))
    grid = np.linspace(-5, 5, 500)
    assert (np.diff(found(grid)) > 0).all()


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for k in range(900):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(rnd.randint(2, 5)):
                text.insert(rnd.randrange(len(text)), rnd.choice(["zorkel", "zorkest", "you grumf", "gr4mf", "GRUMF!!"]))
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, toxic int").repartition(3)
    known = spark.createDataFrame([(k, y, 1) for k, y in labels if k % 5] + [(1, 0, 1), (None, 1, 1), (2, None, 1)], "doc_id long, toxic int, quality int")
    model = T.fit(docs, known)
    out = T.score(docs, model)
    assert out.columns == [*docs.columns, "_toxicity"]
    got = {r["doc_id"]: r["_toxicity"] for r in out.collect()}
    held = [k for k in range(900) if k % 5 == 0]
    y = np.array([labels[k][1] for k in held])
    score = np.array([got[k] for k in held])
    assert auc(score, y) > 0.98 and (score[y == 1] >= 0.3).mean() > 0.9 and (score[y == 0] < 0.3).mean() > 0.95
    assert score.min() >= 0 and score.max() <= 1
    again = T.fit(docs.repartition(5), known)  # the fit does not depend on the rows' places
    assert np.allclose(again.score([rows[0][1], ""]), model.score([rows[0][1], ""]))


def test_the_lexicon_knows_terms_of_all_sampled_rows(spark, corpus):
    rows, labels = corpus
    toxic = [k for k, y in labels if y]
    rare = {f"quux{chr(97 + i)}": toxic[3 * i : 3 * i + 3] for i in range(8)}  # each in three toxic texts
    texts = [(k, " ".join([t, *[w for w, at in rare.items() if k in at]])) for k, t in rows]
    model = T.fit(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [w for w in rare if T.number_of(w) not in model.lexicon.words] == []


def test_features_and_defined_cases(spark, corpus):
    number = T.number_of
    lexicon = T.Lexicon(np.array([number("scum")], np.uint64), np.array([2.0]), np.zeros(0, np.uint64), np.zeros(0), np.array([number("you")], np.uint64))
    x = T.features(["you are scum", "SCUM!!", "a 5cum b", "sooo nice?", "", "!!!", "x" * 100_000, "your scum \x00"], lexicon)
    assert np.isfinite(x).all() and (x[4] == 0).all()
    assert x[0, 13] > 0 and x[7, 13] == 0 and x[0, 3] == 2 and x[1, 15] == 1 and x[1, 17] > 0 and x[2, 20] == 0 and x[3, 16] > 0 and x[3, 18] > 0
    hidden = T.features(["you s@cum", "s$um sc*m"], lexicon)
    assert hidden[1, 21] > 0 and hidden[0, 20] > 0
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, text string")
    one_kind = T.fit(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    none = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [round(r["_toxicity"], 3) for r in T.score(docs, none).collect()] == [0.5] * 3
    assert all(r["_toxicity"] < 0.01 for r in T.score(docs, one_kind).collect())
    assert T.score(docs.limit(0), none).count() == 0


def plain_features(text, words, stems, second):
    """The features of one text, word by word."""
    letter, inside, lower = _tables()
    low = [chr(lower[ord(c)]) for c in text]

    def runs(chars):
        out, start = [], None
        for i, c in enumerate([*chars, " "]):
            if inside[ord(c)] and i < len(chars):
                start = i if start is None else start
            elif start is not None:
                out.append((start, i))
                start = None
        return out

    spans = runs(text)
    terms = ["".join(low[a:b]) for a, b in spans]
    some, length = max(len(terms), 1), max(len(text), 1)
    w = [words.get(t, 0) for t in terms]
    v = [max(stems.get(t[:k], 0) if len(t) >= k else 0 for k in T.STEMS) for t in terms]
    out = []
    for weights in (w, v, [max(x) for x in zip(w, v)]):
        hits = [x for x in weights if x > 0]
        out += [np.log1p(len(hits)), len(hits) / some, sum(hits) / some, max(hits, default=0)]
    at = [i for i, t in enumerate(terms) if t in second]
    near = 0
    for i, (x, y) in enumerate(zip(w, v)):
        if max(x, y) > 0:
            before, after = [j for j in at if j < i], [j for j in at if j >= i]
            near += bool(before) and i - before[-1] <= T.NEAR
            near += bool(after) and after[0] - i <= T.NEAR
    out += [len(at) / some, near / some]
    capital = [bool(letter[ord(c)]) and c != x for c, x in zip(text, low)]
    size = sum(b - a for a, b in spans)
    out += [sum(sum(capital[a:b]) for a, b in spans) / max(size, 1), sum(b - a >= 3 and all(capital[a:b]) for a, b in spans) / some]
    out.append(sum(low[i] == low[i - 1] == low[i - 2] for a, b in spans for i in range(a + 2, b)) / some)
    out += [text.count("!") / length, text.count("?") / length, sum(not letter[ord(c)] and ord(c) > 32 and not c in "0123456789" for c in text) / length]
    alpha = [bool(letter[ord(c)]) for c in text]
    solid = [x or c in T.LOOKALIKES for x, c in zip(alpha, text)]
    between = [0 < i < len(text) - 1 and c in T.LOOKALIKES and solid[i - 1] and solid[i + 1] and (alpha[i - 1] or alpha[i + 1]) for i, c in enumerate(text)]
    read = [T.LOOKALIKES[c] if x else c for c, x in zip(text, between)]
    found = sum(any(between[a:b]) and words.get("".join(chr(lower[ord(c)]) for c in read[a:b]), 0) > 0 for a, b in runs(read))
    return [*out, sum(between) / some, np.log1p(found)]


def test_features_equal_a_plain_version_in_any_batch():
    rnd = random.Random(5)
    words, stems = {"idiot": 2.5, "dumm": 1.25, "ßx": 3.0}, {"trash"[:4]: 1.5, "loser": 2.0}
    pairs = sorted((T.number_of(k), v) for k, v in words.items())
    begun = sorted((int(T.Terms(*T.points_of([k])).stems[T.STEMS.index(len(k))][0]), v) for k, v in stems.items())
    column = lambda rows, k, kind: np.array([r[k] for r in rows], kind)
    lexicon = T.Lexicon(column(pairs, 0, np.uint64), column(pairs, 1, float), column(begun, 0, np.uint64), column(begun, 1, float), np.array([T.number_of(x) for x in T.SECOND_PERSON], np.uint64))
    parts = ["idiot", "IDIOT", "1d!ot", "id1ot", "you", "You", "dumm", "trashy", "tras", "losers", "soooo", "fine", "the", "a$b", "x1", "?", "!!", "42", "ßx", "Été", "@you", "\n", "i*d"]
    texts = ["", " ", "idiot you", "you idiot", "idiot", "you"] + [rnd.choice(["", " "]) + rnd.choice([" ", " ", ", "]).join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(150)]
    want = np.array([plain_features(t, words, stems, set(T.SECOND_PERSON)) for t in texts])
    assert np.allclose(T.features(texts, lexicon), want)
    assert np.allclose(np.concatenate([T.features([t], lexicon) for t in texts]), want)
