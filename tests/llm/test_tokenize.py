import os
import random

import pytest

from pathloom.llm import tokenize as tk

pytestmark = pytest.mark.skipif(not os.path.exists(tk.DEFAULT_VOCABULARY), reason="vocabulary is not here")


@pytest.fixture(scope="module")
def encoder():
    return tk.Encoder(tk.load_ranks(tk.DEFAULT_VOCABULARY))


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("check", pat_str=tk.PIECE_PATTERN, mergeable_ranks=tk.load_ranks(tk.DEFAULT_VOCABULARY), special_tokens={})


def naive(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_equal_the_plain_rule(encoder):
    r = random.Random(1)
    for _ in range(1500):
        piece = bytes(r.choice(b"abcdeilnorst ") if r.random() < 0.8 else r.randrange(256) for _ in range(r.randrange(1, 40)))
        assert tk.merge_piece(piece, encoder.ranks) == naive(piece, encoder.ranks)


TEXTS = ["", "Hello world's end", "<|endoftext|> is text", "naïve café 東京 текст 🙂", " \n\n  x\t\r\n", "a" * 30_000, "0123456789" * 500, "don't I'LL we've", "​﻿½²", "x" + " " * 2000]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_public_library(encoder, public, text):
    assert encoder.encode(text) == public.encode_ordinary(text)


def test_round_trip(encoder):
    back = {v: k for k, v in encoder.ranks.items()}
    for text in TEXTS:
        assert b"".join(back[i] for i in encoder.encode(text)).decode() == text


def test_forgetting_changes_nothing(public, monkeypatch):
    monkeypatch.setattr(tk, "CACHE_PIECES", 3)
    e = tk.Encoder(tk.load_ranks(tk.DEFAULT_VOCABULARY))
    for text in ["one two three four five six", "one two seven", "one two"]:
        assert e.encode(text) == public.encode_ordinary(text)


def test_corpus(spark, public):
    rows = [(1, "some text", 9), (2, None, 9), (3, "", 9), (1, "some text", 9), (4, " \n", 9), (5, "long " * 40_000, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int").selectExpr("*", "0 AS key")
    got = tk.encode_corpus(df)
    assert [f.simpleString() for f in got.schema] == ["doc_id:bigint", "ids:array<int>"]
    ids = {r.doc_id: list(r.ids) for r in got.collect()}
    assert ids == {i: (public.encode_ordinary(t) if t else []) for i, t, _ in rows}
    assert got.count() == 6 and tk.encode_corpus(df.limit(0)).collect() == []
