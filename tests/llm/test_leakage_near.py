"""Size of the passage index, and what it finds of windows that are alike but not equal."""

import random

from pathloom.llm import leakage as lk


def test_the_index_stays_within_its_bytes_a_word():
    rnd = random.Random(1)
    items = [(i, " ".join(f"w{rnd.randrange(20_000)}" for _ in range(100))) for i in range(1000)]
    index = lk.PassageIndex(items, 12, 3)
    assert index.nbytes() <= 100_000 * lk.WORD_BYTES + 20_000 * 64


def test_shared_and_repeated_windows_keep_their_owners():
    text = " ".join(f"k{i}" for i in range(14))
    index = lk.PassageIndex([(5, text), (3, text + " " + text), (4, "short"), (9, None)], 12, 3)
    whole = next(n for n in range(len(index)) if index.words_of(n)[0] == "k0")
    assert index.owners(whole).tolist() == [3, 5] and len(index) == len({index.words_of(n) for n in range(len(index))})


def test_recall_of_windows_alike_to_eight_tenths():
    rnd = random.Random(5)
    window, vocab = 50, [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rnd.choices(vocab, k=60))) for i in range(120)]
    index = lk.PassageIndex(items, window, lk.NEAR_RADIUS)
    at = {index.words_of(n): n for n in range(len(index))}
    found = total = 0
    for _, text in items:
        own = tuple(lk.words(text)[:window])
        other = list(own)
        other[rnd.choice([2, window - 2])] = "changed"
        if index.similarity(tuple(other), at[own]) >= 0.8:
            v = lk.Vocabulary()
            numbers = v.numbers(other)
            total += 1
            found += at[own] in index.candidates(lk.simhashes(v.signs[numbers], window))[1]
    assert total > 100 and found / total >= 0.95


def test_near_passages_are_found_in_documents(spark):
    base = [f"k{i}" for i in range(80)]
    near = base.copy()
    near[1] = "changed"
    docs = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(base[::-1]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(base[:50]))], "item_id bigint, text string")
    got = lk.leaked_items(docs, items, window=50, min_similarity=0.8)
    assert [tuple(r) for r in got.collect()] == [(1, 7)]
    assert lk.leaked_items(docs, items, window=50).collect() == []
