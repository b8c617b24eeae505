import random

import numpy as np
import pytest

from pathloom.llm import leakage as lk


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        w = lk.words(t)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, it in items:
            v = lk.words(it)
            if i is not None and any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def make(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(0, 40)))) for i in range(20)]
    items += [(50, items[3][1] + " tail words"), (51, None), (None, items[4][1]), (52, "")]
    docs = []
    for d in range(120):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 60))]
        if d % 3 == 0:
            v = lk.words(items[r.randrange(20)][1])
            a = r.randrange(0, max(1, len(v)))
            at = r.randrange(len(w) + 1)
            w[at:at] = v[a : a + r.randrange(8, 20)]
        docs.append((d, r.choice([" ", ", ", "_", "\n"]).join(w).upper() if d % 2 else " ".join(w)))
    return docs + [(900, None), (901, ""), (902, "...")] + docs[:5], items


@pytest.mark.parametrize("seed, slice_bytes, chunk", [(1, 1 << 20, 1 << 15), (2, 300, 64)])
def test_against_brute_force(spark, monkeypatch, seed, slice_bytes, chunk):
    monkeypatch.setattr(lk, "CHUNK_WORDS", chunk)
    docs, items = make(seed)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS doc")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc_id")
    got = [tuple(r) for r in lk.leaked_items(d, i, slice_bytes=slice_bytes).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items, 12)


def test_all_prints_within_the_radius_are_candidates():
    r = np.random.default_rng(3)
    index = lk.PassageIndex([(k, " ".join(f"v{x}" for x in r.integers(0, 30, 40))) for k in range(30)], 12, 3)
    prints = np.concatenate([index.prints ^ (np.uint64(1) << np.uint64(r.integers(64))) ^ (np.uint64(1) << np.uint64(r.integers(64))) for _ in range(3)])
    at, which = index.candidates(prints)
    near = np.bitwise_count(prints[:, None] ^ index.prints[None, :]) <= 3
    assert set(zip(at.tolist(), which.tolist())) == set(zip(*map(list, map(np.ndarray.tolist, np.nonzero(near)))))


def test_words():
    assert lk.words("A_b-C1 é²́x") == ["a", "b", "c1", "é²", "x"]


def test_long_text_and_empty_tables(spark):
    item = " ".join(f"k{i}" for i in range(30))
    text = " ".join(f"n{i % 977}" for i in range(120_000)) + " " + item
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert [tuple(r) for r in lk.leaked_items(d, i).collect()] == [(1, 7)]
    assert lk.leaked_items(d.limit(0), i).collect() == [] == lk.leaked_items(d, i.limit(0)).collect()
    assert lk.leaked_items(d, spark.createDataFrame([(7, "too short")], "item_id bigint, text string")).collect() == []


def test_near_windows_count_below_full_similarity(spark):
    base = [f"k{i}" for i in range(12)]
    index = lk.PassageIndex([(1, " ".join(base))], 12, 3)
    assert index.similarity(tuple(base), 0) == 1.0
    other = tuple([*base[:11], "other"])
    assert 0.5 < index.similarity(other, 0) < 1.0
