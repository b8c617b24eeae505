from pathloom.plans import queries


def test_mentions_of_every_triple_variant(spark, tmp_path):
    d = str(tmp_path)
    cells = [(1, "kg_triples", "<a, p, b>"), (1, "kg_triples_top1", "<b, p, c>"), (2, "kg_triples_top2", "c"), (2, "entity_bfs", "<a, p, b>"), (3, "kg_triples_top1", None)]
    spark.createDataFrame(cells, "pair_id bigint, variant string, paths string").write.parquet(f"{d}/context_variants.parquet")
    vectors = [("entities", f"Q{i}", label, {"text": ""}) for i, label in enumerate("abc", 1)]
    columns = "collection string, id string, document string, metadata map<string,string>"
    spark.createDataFrame(vectors, columns).write.parquet(f"{d}/vector_collection.parquet")
    got = lambda name: {tuple(r.asDict()[c] for c in sorted(r.asDict())) for r in queries.QUERIES[name](spark, d).collect()}
    members = {"kg_triples": (1, "apb"), "kg_triples_top1": (1, "bpc"), "kg_triples_top2": (2, "c")}
    assert got("parse_mentions") == {(m, i, n, v) for v, (i, ms) in members.items() for n, m in enumerate(ms)}
    assert got("link_mentions") == {("Q1, Q2", 1, "kg_triples"), ("Q2, Q3", 1, "kg_triples_top1"), ("Q3", 2, "kg_triples_top2")}
    assert got("entity_link_top1") == {("Q1", "a"), ("Q2", "b"), ("Q3", "c"), (None, "p")}
