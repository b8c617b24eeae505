from pyspark.sql import functions as F

from pathloom.operators import ranking

STEP = "array<struct<kind:string,id:string>>"


def path(*ids):
    return [("entity" if i % 2 == 0 else "predicate", x) for i, x in enumerate(ids)]


def test_two_best_paths_in_input_order(spark):
    rows = [("q", 0, path("a", "p", "b")), ("q", 1, path("a", "p", "b", "p", "c")), ("q", 2, path("a", "p", "b", "p", "c", "r", "d")), ("q", 3, path("a", "r", "b", "p", "c", "p", "e")), ("z", 0, path("a", "p", "b"))]
    df = spark.createDataFrame(rows, f"question_id string, idx int, steps {STEP}").withColumn("score", ranking.path_score(F.col("steps")))
    best = ranking.prune_paths(df, "question_id", "score", ["idx"])
    assert sorted((r.question_id, r.rank_no, r.idx, r.score) for r in best.collect()) == [("q", 1, 2, 3), ("q", 2, 3, 3), ("z", 1, 0, 1)]
    assert {r.predicate for r in ranking.predicate_vocab(df).collect()} == {"p", "r"}


def test_labels_fall_back_to_ids(spark):
    labels = spark.createDataFrame([("Q1", "one"), ("P1", "to")], "id string, label string")
    paths = spark.createDataFrame([("k", path("Q1", "P1", "Q2"))], f"key string, steps {STEP}")
    assert ranking.label_paths(paths, labels).first().text == "one (Q1) --[to] (P1)--> Q2 (Q2)"
    triples = [("Q1", "Q2", "P1"), ("Q2", "Q3", "P9")]
    bfs = spark.createDataFrame([("k", triples)], "key string, path array<struct<source:string,target:string,prop:string>>")
    assert ranking.label_bfs_paths(bfs, labels).first().text == "one (Q1), to (P1), Q2 (Q2) -> Q2 (Q2), P9 (P9), Q3 (Q3)"


def test_unlabelled_triples_leave_gaps(spark):
    labels = spark.createDataFrame([("Q1", "one"), ("P1", "to"), ("Q2", "two")], "id string, label string")
    rows = [(1, "Q1", "P1", "Q2"), (2, "Q1", "P1", "Q9"), (3, "Q2", "P1", "Q1"), (4, None, "P1", "Q1")]
    triples = spark.createDataFrame(rows, "rank_no int, head_id string, relation_id string, tail_id string")
    kept = ranking.label_triples(triples, labels).filter("english_triplet is not null").orderBy("rank_no").collect()
    assert [(r.rank_no, r.english_triplet) for r in kept] == [(1, "<one, to, two>"), (3, "<two, to, one>")]
    assert {r.id for r in ranking.label_worklist(triples).collect()} == {"Q1", "Q2", "Q9", "P1"}
    assert ranking.valid_triples(triples, strict=True).count() == 3 == ranking.valid_triples(triples, strict=False).count()


def test_mentions_link_to_the_smallest_id(spark):
    labels = spark.createDataFrame([("Q2", "Bed "), ("Q1", "bed"), ("Q3", None)], "id string, label string")
    rows = [(1, 0, "BED"), (1, 1, "nothing"), (1, 2, " bed"), (2, 0, "none")]
    mentions = spark.createDataFrame(rows, "pair_id int, pos int, mention string")
    assert [tuple(r) for r in ranking.link_mentions(mentions, labels, "pair_id").collect()] == [(1, "Q1, Q1")]
    assert dict(tuple(r) for r in ranking.link_top1(mentions, labels).collect())["nothing"] is None
