"""Packing: an exact round trip, and few sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from watchtide.llm import packing as P
from watchtide.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_file(tokenizer):
    encode = Encoder(PATH)
    for text in ["", " ", "it's  a\n\ntest \t", "<|endoftext|> x", "é" * 3000, "a" * 20000, " " * 5000, "x\x00  ' S", "1234 $$$ ***"]:
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, prose, tokenizer):
    rnd, make = prose(3)
    rows = [(k, make(int(rnd.expovariate(1 / 120)))) for k in range(300)] + [(300, None), (301, ""), (302, make(4000)), (303, "<|endoftext|>"), (7, make(5)), (None, "x")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, piece int").repartition(3)
    out = P.pack(df, PATH, capacity=256, open_bins=64).collect()
    ids = {}
    for doc, text in rows:
        ids.setdefault(doc, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
    pieces = {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(ids)
    for doc, lists in ids.items():
        want = sorted((k, s, n, zlib.crc32(np.array(x[s : s + n], "<u4").tobytes())) for x in lists for k, (s, n) in enumerate(P.pieces(len(x), 256)))
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[doc]) == want
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in out)
    assert len(places) <= 1.03 * total / 256 + 3
    assert P.pack(df.limit(0), PATH).count() == 0


def test_pieces():
    assert P.pieces(1, 8) == [(0, 1)] and P.pieces(8, 8) == [(0, 8)] and P.pieces(19, 8) == [(0, 3), (3, 8), (11, 8)] and P.pieces(16, 8) == [(0, 8), (8, 8)]


def test_bounded_best_fit_takes_the_fullest_that_fits_and_closes_the_fullest():
    rnd, most, capacity = random.Random(1), 5, 50
    bins = P.Bins(capacity, most)
    free: dict[int, int] = {}
    for _ in range(3000):
        length = rnd.randint(1, capacity)
        at, offset = bins.place(length)
        fits = [f for f in free.values() if f >= length]
        if fits:
            assert free[at] == min(fits)
        else:
            assert at not in free and offset == 0
            if len(free) >= most:
                smallest = min(free.values())
                gone = [b for b in free if free[b] == smallest and b not in {x for lists in bins.by_free for x in lists}]
                del free[gone[0]]
            free[at] = capacity
        assert offset == capacity - free[at]
        free[at] -= length
        if not free[at]:
            del free[at]
        assert len(free) == bins.n_open <= most
