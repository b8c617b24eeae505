import itertools
import random
from collections import deque

import pytest

from pathloom.operators import graph

EDGES = "head string, predicate string, tail string"


def multigraph(seed, nodes=14, n=60):
    r = random.Random(seed)
    return sorted({(f"Q{r.randrange(nodes)}", f"P{r.randrange(3)}", f"Q{r.randrange(nodes)}") for _ in range(n)})


def queue_search(capped, start, end, depth, most):
    """First-in first-out search, a node marked when it is queued."""
    out = {}
    for h, p, t, o in sorted(capped, key=lambda x: (x[0], x[3])):
        out.setdefault(h, []).append((p, t))
    seen, queue, results = {start}, deque([(start, [])]), []
    while queue:
        node, path = queue.popleft()
        if end is not None and node == end:
            return [path] if path else []
        if len(path) == depth:
            if end is None:
                results.append(path)
                if len(results) == most:
                    return results
            continue
        for p, t in out.get(node, ()):
            if t not in seen:
                seen.add(t)
                queue.append((t, [*path, (node, t, p)]))
    return results


@pytest.fixture(params=[3, 4])
def world(request, spark):
    edges = multigraph(request.param)
    df = spark.createDataFrame(edges, EDGES)
    capped = graph.capped_edges(df, claims=3, per_node=4)
    return edges, df, capped, [tuple(r) for r in capped.collect()]


def test_caps(spark):
    rows = [("Q1", "P1", f"Q{i:03d}") for i in range(9)] + [("Q1", f"P{i:03d}", "Q5") for i in range(2, 80)] + [("Q1", "P1", "Q000")]
    got = sorted((r.edge_ord, r.predicate, r.tail) for r in graph.capped_edges(spark.createDataFrame(rows, EDGES)).collect())
    want = sorted({(p, t) for _, p, t in rows if p != "P1"}) + [("P1", f"Q{i:03d}") for i in range(5)]
    want = sorted(want)[:50]
    assert got == [(i, *w) for i, w in enumerate(want, 1)]


def test_pair_search_equals_the_queue(spark, world):
    _, _, capped, rows = world
    pairs = [(f"Q{a}", f"Q{b}") for a, b in itertools.product(range(0, 14, 2), range(14))]
    got = {(r.s, r.e): [tuple(t) for t in r.path] for r in graph.bfs_pair_paths(spark.createDataFrame(pairs, "s string, e string"), capped).collect()}
    want = {(s, e): p[0] for s, e in pairs if (p := queue_search(rows, s, e, 3, 1))}
    assert got == want


def test_single_search_equals_the_queue(spark, world):
    _, _, capped, rows = world
    starts = [(f"Q{a}",) for a in range(14)]
    got = {(r.s, r.path_no): [tuple(t) for t in r.path] for r in graph.bfs_single_paths(spark.createDataFrame(starts, "s string"), capped).collect()}
    want = {(s, i): p for (s,) in starts for i, p in enumerate(queue_search(rows, s, None, 3, 5), 1)}
    assert got == want


def patterns(edges, s, e):
    one, two, three = set(), set(), set()
    for h, p, t in edges:
        if (h, t) in ((s, e), (e, s)):
            one.add((p,))
        for h2, p2, t2 in edges:
            if t == s and h2 == e and t2 == h and p2 == p:
                one.add((p,))
            if t not in (s, e) and h2 == t and ((h == s and t2 == e) or (h == e and t2 == s)):
                two.add((p, t, p2))
            if h not in (s, e) and h == h2 and t == s and t2 == e:
                two.add((p, h, p2))
            if t != h2 or t in (s, e) or t2 in (s, e):
                continue
            for h3, p3, t3 in edges:
                if h3 == t2 and h == s and t3 == e:
                    three.add((p, t, p2, t2, p3))
                if h3 == t2 and h == e and t3 == s:
                    three |= {(p, t, p2, t2, p3), (p3, t2, p2, t, p)}
    return one, two, three


def test_patterns(spark, world):
    edges, df, _, _ = world
    pairs = [(f"Q{a}", f"Q{b}") for a, b in itertools.product(range(4), range(5))]
    p = spark.createDataFrame(pairs, "s string, e string")
    for k, search in enumerate((graph.paths_1hop, graph.paths_2hop, graph.paths_3hop)):
        got = {tuple(r) for r in search(p, df, limit=10_000).collect()}
        assert got == {(s, e, *x) for s, e in pairs for x in patterns(edges, s, e)[k]}
    found = graph.find_paths(p, df, 3, 10_000).collect()
    assert all(r.steps[0].id == r.s and r.steps[-1].id == r.e and len(r.steps) == 2 * r.hops + 1 for r in found)


def test_a_pair_with_more_paths_than_the_limit(spark):
    rows = [("S", "P1", f"M{i:03d}") for i in range(150)] + [(f"M{i:03d}", "P2", "E") for i in range(150)]
    pairs = spark.createDataFrame([("S", "E"), ("S", "E")], "s string, e string")
    got = sorted(r.m1 for r in graph.paths_2hop(pairs, spark.createDataFrame(rows, EDGES)).collect())
    assert got == [f"M{i:03d}" for i in range(100)]


def test_entity_pairs(spark):
    lists = spark.createDataFrame([("a", ["Q1", "Q2", "Q1"]), ("b", ["Q1"]), ("c", []), ("d", None), ("e", [f"Q{i}" for i in range(12)])], "q string, ids array<string>")
    rows = [tuple(r) for r in graph.entity_pairs(lists, "q", "ids").collect()]
    assert sorted(r for r in rows if r[0] == "a") == [("a", 0, "Q1", "Q2"), ("a", 1, "Q1", "Q1"), ("a", 2, "Q2", "Q1")]
    assert {r[0] for r in rows} == {"a", "e"} and sum(r[0] == "e" for r in rows) == 45
    assert graph.entity_pairs(lists, "q", "ids", 3).filter("q = 'e'").count() == 3


def test_empty_graph(spark):
    none = spark.createDataFrame([], EDGES)
    pairs = spark.createDataFrame([("A", "B"), ("A", "A")], "s string, e string")
    assert graph.find_paths(pairs, none).collect() == []
    assert graph.bfs_pair_paths(pairs, graph.capped_edges(none)).collect() == []
    with pytest.raises(ValueError):
        graph.find_paths(pairs, none, 4)
