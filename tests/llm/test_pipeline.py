"""The pipeline stage by stage against brute force, and the registered queries."""

import re

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as P
from test_dartminhash import classes
from test_decontaminate import expected as hits
from watchtide.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    import random

    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghijklmnoprstuvwz") for _ in range(rnd.randint(2, 8))) for _ in range(600)]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, bench = make(70), [make(25) for _ in range(6)]
    rows = []
    for k in range(160):
        text = make(rnd.randint(10, 200))
        if k % 9 == 0:
            text = f"{make(20)} {passage} {make(20)}"
        if k % 7 == 0:
            text = f"{make(15)} {rnd.choice(bench)} {make(15)}"
        if k % 11 == 0 and rows:
            text = rows[rnd.randrange(len(rows))][1] or ""
        if k % 13 == 0 and rows:
            w = (rows[rnd.randrange(len(rows))][1] or "").split()
            text = " ".join(w[:-1] + make(1).split())
        rows.append((k, text, rnd.choice(["aa", None]), "s", len(text)))
    rows += [(500, None, "aa", "s", None), (501, "", "aa", None, 0), (502, "12 34", "aa", "s", 5), (3, rows[3][1], "aa", "s", rows[3][4]), (None, make(30), "aa", "s", None), (503, make(4000), "aa", "s", None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(f"i{k}", x) for k, x in enumerate(bench)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    return folder, rows, [(f"i{k}", x) for k, x in enumerate(bench)]


def keep(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_stages_equal_brute_force(spark, corpus):
    folder, rows, bench = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    stages = dict(P.STAGES)

    def step(name, docs):
        out = stages[name](spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        return spark.createDataFrame(out.collect(), out.schema)

    one = step("language_id", docs)
    want = [(i, t) for i, t, *_ in rows if re.search(r"[^\W\d_]", t or "")]
    assert sorted(keep(one.collect()), key=str) == sorted(want, key=str)

    two = step("near_dedup", one)
    named = {i: t for i, t in want if i is not None}
    root = classes(sorted(named.items()))
    kept = {(i, t) for i, t in named.items() if root[i] == i} | {(i, t) for i, t in want if i is None}
    assert sorted(keep(two.collect()), key=str) == sorted(kept, key=str)

    three = step("suffix_dedup", two)
    by_order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
    seen, cut = set(), []
    for i, t in by_order:
        raw = t.encode()
        windows = [raw[k : k + 50] for k in range(len(raw) - 49)]
        gone = {k + j for k, w in enumerate(windows) if w in seen for j in range(50)}
        seen |= set(windows)
        cut.append((i, bytes(b for k, b in enumerate(raw) if k not in gone).decode()))
    assert sorted(keep(three.collect()), key=str) == sorted(cut, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in three.collect())

    four = step("decontamination", three)
    left = keep(four.collect())
    assert all(n == 0 for _, _, n, _ in hits(left, bench))
    clean = {d for d, _, n, _ in hits(cut, bench) if n == 0}
    assert sorted(x for x in left if x[0] in clean and x[0] is not None) == sorted(x for x in cut if x[0] in clean and x[0] is not None)

    five = step("packing", four).collect()
    size = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    assert sum(r["length"] for r in five) == sum(len(size(t, add_special_tokens=False).ids) + 1 for _, t in left)


def test_stages_lose_no_row_and_no_column(spark, corpus, prose):
    """Rows that share a doc_id, names that stages use themselves, and cut texts."""
    folder, rows, bench = corpus
    _, make = prose(31)
    texts = [make(60), make(60), make(60)]
    extra = [(900, texts[0]), (900, texts[1]), (901, texts[2]), (900, texts[0]), (902, texts[2] + " tail"), (903, f"{make(20)} {bench[0][1]} {make(20)}")]
    df = spark.createDataFrame([(i, t, "aa", "s", len(t), 77, f"c{k}", k, "x", 5) for k, (i, t) in enumerate(extra)], COLUMNS + ", _lang int, _copy string, key int, `a.b` string, class_id int")
    stages = dict(P.STAGES)
    one = stages["language_id"](spark, df, folder)
    assert one.columns == df.columns and sorted(one.collect(), key=str) == sorted(df.collect(), key=str)
    two = stages["near_dedup"](spark, one, folder)
    assert two.columns == df.columns
    got = two.collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted({(i, t) for i, t in extra if i != 902})
    assert {r["_lang"] for r in got} == {77} and all(r["_copy"] == f"c{r['key']}" for r in got)
    four = stages["decontamination"](spark, two, folder).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in four) and min(len(r["text"].split()) for r in four if r["doc_id"] == 903) < 60
    for stage in ("language_id", "near_dedup", "suffix_dedup", "decontamination"):
        assert stages[stage](spark, df.limit(0), folder).collect() == []


def test_run_applies_all_stages(spark, corpus):
    folder, rows, _ = corpus
    out = P.run(spark, folder).collect()
    assert out and {r["doc_id"] for r in out} <= {r[0] for r in rows}


def test_every_operator_is_registered(spark):
    names = [n for n in Q.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in Q.QUERIES
    assert set(Q.QUERIES) <= set(entry.queries()) and set(Q.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_run_over_the_whole_table(spark, name):
    df = Q.QUERIES[name](spark, SF)
    rows = df.collect()
    con = duckdb.connect()
    per_row = {"op1_warc": "pages", "op4_html_extraction": "pages"} | {n: "documents" for n in Q.QUERIES if re.match(r"op(2|5|6|7|8|10|11|12)_", n)}
    if name in per_row:
        assert len(rows) == con.sql(f"SELECT count(*) FROM '{SF}/{per_row[name]}.parquet'").fetchall()[0][0]
    assert rows
