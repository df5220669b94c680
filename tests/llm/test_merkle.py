"""The manifest against a plain tree, with deep and lone sources."""

import hashlib
import random

import pytest

from watchtide.llm import merkle as M


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain(leaves: list[str]) -> tuple[str, list[list[tuple[int, str]]]]:
    level, places = leaves, list(range(len(leaves)))
    steps = [[] for _ in leaves]
    while len(level) > 1:
        for i, p in enumerate(places):
            run = level[p // 16 * 16 : p // 16 * 16 + 16]
            steps[i].append((p % 16, "".join(run[: p % 16] + run[p % 16 + 1 :])))
        level = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
        places = [p // 16 for p in places]
    return level[0], steps


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 600])
def test_appends_give_the_plain_tree(n):
    leaves = [sha(str(i)) for i in range(n)]
    tree = M.Tree()
    for x in leaves:
        tree.append(x)
    assert (tree.close(), tree.witness) == plain(leaves)


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((-(2**63) if r[0] is None else r[0], sha("".join(map(field, (r[0], r[1], r[2], r[4], r[3])))), r[0]))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: plain([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in order}
    root, tops = plain([subs[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, digest, doc), steps in zip(sorted(by[s], key=lambda x: x[:2]), subs[s][1]):
            out.append((doc, s, digest, subs[s][0], root, tuple(steps + top)))
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, source string, lang string, text string, n_chars long, tree int, digest string").repartition(parts)
    got = M.manifest(df, again=M.folded(M.F.lit("x"), M.F.array().cast(M._STEPS))).collect()
    assert {r["again"] for r in got} <= {"x"}
    plainly = sorted(((r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], tuple((w["place"], w["siblings"]) for w in r["witness"])) for r in got), key=str)
    assert plainly == sorted(expected(rows), key=str)


def test_sources_of_all_sizes(spark, monkeypatch):
    rnd = random.Random(4)
    sizes = {None: 3, "": 1, "a": 300, "é": 16, "z": 1, "B": 17} | {f"s{k}": 1 for k in range(30)}
    rows = [(i, s, rnd.choice([None, "en"]), rnd.choice([None, "", "Text é" * 3, "x" * 3000]), rnd.choice([None, i])) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rnd.shuffle(rows)
    rows += rows[:3] + [(None, "a", None, None, None), (None, None, None, "q", 1)]
    check(spark, rows)


def test_rounds_of_blocks(spark):
    rows = [(i * 3 % 9001, "one", "en", str(i), i) for i in range(9001)] + [(i, "two", None, None, None) for i in range(4096)] + [(i, "three", None, None, None) for i in range(4097)]
    check(spark, rows, 7)


def test_empty_and_lone(spark):
    none = spark.createDataFrame([], "doc_id long, source string, lang string, text string, n_chars long")
    assert M.manifest(none).collect() == []
    one = M.manifest(spark.createDataFrame([(5, None, None, "A", None)], none.schema)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == sha("1:5--" + "-1:A") and one["witness"] == []


def test_a_changed_leaf_gives_another_root(spark):
    rows = [(i, "s", "en", f"T{i}", 1) for i in range(40)]
    out = M.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, n_chars long"))
    got = out.select("root", M.folded(M.F.col("leaf")).alias("same"), M.folded(M.F.sha2(M.F.col("leaf"), 256)).alias("other")).collect()
    assert all(r["same"] == r["root"] != r["other"] for r in got)
