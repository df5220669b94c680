"""WARC archives: a round trip at any split, and damage."""

import gzip
import io

import pytest
from pyspark.sql import functions as F

from watchtide.llm import warc as W


@pytest.fixture
def pages(prose):
    rnd, make = prose(6)
    rows = [(k, f"http://h{k % 3}.example/{k}", f"<p>{make(rnd.randint(0, 300))}") for k in range(80)]
    rows += [(100, "http://x/", rows[3][2]), (101, None, rows[3][2]), (2, "http://y/", rows[50][2]), (102, "http://z/", None), (103, "http://z/", ""), (104, "u\r\nv", "é\r\n\r\nWARC/1.1\r\n"), (None, "http://n/", rows[3][2]), (None, "http://n/", "alone")]
    return rows + [(105, "http://r/", "same"), (105, "http://r/", "same"), (106, "http://big/", make(60000))]


@pytest.mark.parametrize("split", [1 << 25, 3000, 333])
def test_round_trip_at_any_split(spark, pages, split, tmp_path):
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    folder = f"{tmp_path}/a"
    archives = W.write(df, folder)
    records = W.read(archives, folder, split)
    got = records.collect()
    assert len(got) == len(pages) and len({(r["path"], r["place"]) for r in got}) == len(pages)
    for r in got:
        assert r["record_type"] in ("response", "revisit") and (r["payload"] is None) == (r["record_type"] == "revisit")
    name = lambda i: "<urn:page:>" if i is None else f"<urn:page:{i}>"
    least = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    want = sorted((name(i), len((h or "").encode()), W.payload_digest((h or "").encode()), name(least[h or ""]) if (h or "") in least and i != least[h or ""] else None) for i, _, h in pages)
    assert sorted(((r["record_id"], r["content_length"], r["digest"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    full = W.resolved(records).collect()
    assert sorted((r["record_id"], bytes(r["payload"])) for r in full) == sorted((name(i), (h or "").encode()) for i, _, h in pages)
    assert W.listing(spark, folder).count() == archives.count()


def test_a_threshold_keeps_small_payloads_as_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    folder = f"{tmp_path}/a"
    got = {r["record_id"]: r["record_type"] for r in W.read(W.write(df, folder, least_bytes=3), folder).collect()}
    assert got == {"<urn:page:1>": "response", "<urn:page:2>": "response", "<urn:page:3>": "response", "<urn:page:4>": "revisit"}
    assert W.read(W.write(df.limit(0), f"{tmp_path}/b"), f"{tmp_path}/b").count() == 0


def test_headers_of_any_length(spark, tmp_path):
    long = "http://x/" + "ab" * (1 << 20)
    df = spark.createDataFrame([(1, long, "<p>a"), (2, long + "c", "<p>a"), (3, "u", "<p>b")], "page_id long, url string, html string")
    got = {r["record_id"]: r for r in W.read(W.write(df, f"{tmp_path}/a"), f"{tmp_path}/a", 1000).collect()}
    assert {k: (r["record_type"], r["uri"]) for k, r in got.items()} == {"<urn:page:1>": ("response", long), "<urn:page:2>": ("revisit", long + "c"), "<urn:page:3>": ("response", "u")}


def records_of(data, split):
    out = []
    for start in range(0, len(data), split):
        out += W.read_range(io.BytesIO(data), len(data), start, min(len(data), start + split))
    return out


@pytest.mark.parametrize("split", [50, 700, 10_000, 10_000_000])
def test_false_magic_and_damage_are_skipped(split):
    inner = W.page_record(9, "u", b"inside", None, False, "d")
    stored = W.record({"WARC-Type": "resource"}, W.MAGIC * 200 + gzip.compress(b"not a record"), level=0)
    good = [W.page_record(k, "u", b"x" * (k * 100), None, False, "d") for k in range(5)]
    broken = bytearray(W.page_record(7, "u", bytes(range(256)) * 30, None, False, "d"))
    broken[len(broken) // 2] ^= 0xFF
    data = good[0] + b"garbage" + good[1] + stored + bytes(broken) + good[2] + W.MAGIC + b"\x00" * 40 + good[3] + good[4][:-5]
    found = records_of(data, split)
    kinds = [f["warc-type"] for _, _, f, _ in found]
    assert kinds.count("response") == 4 and kinds.count("resource") == 1 and kinds.count("damaged") == 2
    assert len({p for p, *_ in found}) == len(found) and inner


def test_page_names(spark):
    df = spark.createDataFrame([("<urn:page:12>",), ("<urn:page:>",), (None,), ("<urn:uuid:1>",)], "n string")
    assert [r[0] for r in df.select(W.page_of("n")).collect()] == [12, None, None, None]
    assert df.select(F.count("*")).first()[0] == 4
