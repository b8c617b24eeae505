"""The path queries at three hops, against brute force over the edges of a small made folder."""

import itertools
import random

import pytest

from pathloom.plans import queries

ENTITIES = [f"Q{i}" for i in range(1, 13)]
#: Joined only by three hops: Q20 to Q23.
CHAIN = [("Q20", "P20", "Q21"), ("Q21", "P21", "Q22"), ("Q22", "P22", "Q23")]
LISTS = {"a": ENTITIES[:6], "b": ENTITIES[4:10], "c": ["Q20", "Q23"], "d": ["Q20", "Q40"], "e": ["Q1"]}


def made_edges():
    r = random.Random(7)
    return sorted({(r.choice(ENTITIES), f"P{r.randrange(1, 4)}", r.choice(ENTITIES)) for _ in range(22)}) + CHAIN


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("paths")
    triple = "a ({}), p ({}), b ({})"
    sheet = [(i, q, ", ".join(ids), triple.format(*CHAIN[0])) for i, (q, ids) in enumerate(LISTS.items())]
    columns = "pair_id bigint, question_id string, wikidata_entities string, wikidata_paths_llm string, loaded_at string, asked_at string"
    spark.createDataFrame([(*x, "", "") for x in sheet], columns).write.parquet(f"{d}/question_sheet.parquet")
    cells = [(i, "entity_bfs", triple.format(*e)) for i, e in enumerate(made_edges())]
    spark.createDataFrame(cells, "pair_id bigint, variant string, paths string").write.parquet(f"{d}/context_variants.parquet")
    vectors = [("questions", q, "", {"text": ""}, [1.0] * 64) for q in LISTS]
    vectors += [("entities", q, f"label {q}", {"text": ""}, [1.0] * 64) for q in ENTITIES]
    columns = "collection string, id string, document string, metadata map<string,string>, embedding array<float>"
    spark.createDataFrame(vectors, columns).write.parquet(f"{d}/vector_collection.parquet")
    columns = "question_id string, similar_relations array<struct<id:string,text:string,score:double>>"
    spark.createDataFrame([("a", [("P1", "property 1", 0.5)])], columns).write.parquet(f"{d}/similarity_results.parquet")
    return str(d)


def brute():
    """{(s, e): paths as id tuples}, written out from the three patterns of the reference; no pair here has over 100."""
    edges = made_edges()
    out = {}
    for s, e in {p for ids in LISTS.values() for p in itertools.combinations(ids, 2)}:
        found = {(s, p, e) for h, p, t in edges if (h, t) in ((s, e), (e, s))}
        for (h1, p1, t1), (h2, p2, t2) in itertools.product(edges, edges):
            if t1 == s and h2 == e and t2 == h1 and p1 == p2:
                found.add((s, p1, e))
            for m, joined in ((t1, h1 == s and h2 == t1 and t2 == e), (t1, h1 == e and h2 == t1 and t2 == s), (h1, t1 == s and h2 == h1 and t2 == e)):
                if joined and m not in (s, e):
                    found.add((s, p1, m, p2, e))
        for (h1, p1, m1), (h2, p2, m2), (h3, p3, t3) in itertools.product(edges, edges, edges):
            if h2 == m1 and h3 == m2 and not {m1, m2} & {s, e}:
                if (h1, t3) == (s, e):
                    found.add((s, p1, m1, p2, m2, p3, e))
                if (h1, t3) == (e, s):
                    found |= {(s, p1, m1, p2, m2, p3, e), (s, p3, m2, p2, m1, p1, e)}
        out[s, e] = found
    assert max(map(len, out.values())) <= 100
    return out


def rows(spark, folder, name):
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, folder).collect())


def text(path):
    label = lambda x: f"label {x}" if x in ENTITIES else "property 1" if x == "P1" else x
    return " ".join(f"{label(x)} ({x})" if i % 2 == 0 else f"--[{label(x)}] ({x})-->" for i, x in enumerate(path))


def test_paths_of_three_hops_are_scored_and_counted(spark, folder):
    found = brute()
    paths = [(s, e, p) for (s, e), ps in found.items() for p in ps]
    assert rows(spark, folder, "path_score") == sorted((s, e, "|".join(p), len(p) // 2) for s, e, p in paths)
    assert rows(spark, folder, "predicate_vocab") == sorted({(x,) for _, _, p in paths for x in p[1::2]})
    distinct = {p for _, _, p in paths}
    members = {("entity" if i % 2 == 0 else "predicate", x) for p in distinct for i, x in enumerate(p)}
    assert rows(spark, folder, "path_node_stats") == sorted((k, x, sum(x in p for p in distinct)) for k, x in members)
    sizes = [sum(k == kind for k, _ in members) for kind in ("entity", "predicate")]
    assert rows(spark, folder, "run_stats") == [(len(found), len(paths), *sizes)]


def test_paths_of_three_hops_are_written_and_ranked(spark, folder):
    found = brute()
    want = [(s, e, t) for (s, e), ps in found.items() for t in (map(text, ps) if ps else ["No path found"])]
    assert ("Q20", "Q23", text(("Q20", "P20", "Q21", "P21", "Q22", "P22", "Q23"))) in want
    assert rows(spark, folder, "format_pattern_paths") == sorted(want)
    best = []
    for q, ids in LISTS.items():
        mine = {p for pair in itertools.combinations(ids, 2) for p in found[pair]}
        top = sorted(mine, key=lambda p: (-len(p), "|".join(p)))[:2]
        if top:
            best.append((q, " | ".join(map(text, top)), " | ".join(str(len(p) // 2) for p in top)))
    assert rows(spark, folder, "path_rank_top2") == sorted(best)
