import random

from pyspark.sql import functions as F

from pathloom.llm import repetition as rp
from pathloom.llm.leakage import words


def brute(text, n=5):
    w = words(text)
    seen, covered = {}, set()
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            covered.update(range(i, i + n))
        seen.setdefault(g, i)
    return len(covered), len(w)


def make(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(150):
        w = [f"w{r.randrange(9)}" for _ in range(r.randrange(0, 50))]
        for _ in range(r.randrange(3)):
            if len(w) > 6:
                a = r.randrange(len(w) - 5)
                w += w[a : a + r.randrange(4, 9)]
        texts.append(r.choice([" ", "-", "_", ".\n"]).join(w))
    return texts + ["a a a a a a", "a b c d e", "a b c d e a b c d e", "A b C d E! a B c D e", None, "", "   ", "..!?", "İx é́ ½ x" * 5]


def test_against_brute_force(spark):
    texts = make(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("_words", F.lit("clash")).withColumn("n_words", F.lit(-1))
    got = {r.doc_id: (r.n_repeated_words, r.n_words, r.repeated_share) for r in rp.repetition_metrics(docs).collect()}
    for i, t in enumerate(texts):
        c, n = brute(t)
        assert got[i] == (c, n, c / n if n else 0.0), t
    want = {i for i, t in enumerate(texts) for c, n in [brute(t)] if n and c / n >= 0.3}
    assert {r.doc_id for r in rp.repetitive_documents(docs).collect()} == want


def test_rows_repeat_and_tables_may_be_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e a b c d e"), (1, "a b c d e a b c d e"), (None, "x y z u v x y z u v")], "doc_id bigint, text string")
    assert sorted(r.doc_id or 0 for r in rp.repetitive_documents(docs).collect()) == [0, 1]
    assert rp.repetitive_documents(docs.limit(0)).collect() == []


def test_long_text(spark):
    text = " ".join(f"u{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, text + " " + text)], "doc_id bigint, text string")
    assert {r.doc_id for r in rp.repetitive_documents(docs).collect()} == {2}


def test_threshold_table(spark):
    rows = [(1, "the line\nthe line\nthe line\nother words here"), (2, "#### !!!! ....  x"), (3, "one two"), (4, None)]
    flags = rp.repetition_flags(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r.doc_id: r.asDict() for r in flags.collect()}
    assert got[1]["is_repeated_lines"] and not got[1]["is_very_short"] and not got[1]["is_no_stop_words"]
    assert got[2]["is_mostly_symbols"] and got[3]["is_very_short"] and got[4]["is_very_short"] and got[4]["repeated_share"] == 0


def test_words_are_split_once(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    plan = rp.repetitive_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
