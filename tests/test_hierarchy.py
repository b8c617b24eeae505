import random

import pytest

from pathloom.operators.hierarchy import build_hierarchy, descendant_pairs, hierarchy_links, other_parents

SCHEMA = "triple_id string, head_id string, relation_id string, tail_id string"


def brute(parent):
    nodes = set(parent) | set(parent.values())
    rows = set()
    for n in nodes:
        seen = [n]
        while seen[-1] in parent and parent[seen[-1]] not in seen:
            seen.append(parent[seen[-1]])
        cyclic = seen[-1] in parent
        below = {m for m in nodes if m != n and n in ancestors(parent, m)}
        if cyclic:
            ring = seen[seen.index(parent[seen[-1]]) :]
            rows.add((n, min(ring), -1, "", len(below)))
        else:
            rows.add((n, seen[-1], len(seen) - 1, "/".join(reversed(seen)), len(below)))
    return rows


def ancestors(parent, n):
    out, at = set(), n
    while at in parent and parent[at] not in out:
        at = parent[at]
        out.add(at)
    return out


def forest(seed, n):
    r = random.Random(seed)
    parent = {}
    for i in range(n):
        roll = r.random()
        if roll < 0.1:
            continue
        parent[f"Q{i}"] = f"Q{r.randrange(i) if i and roll < 0.95 else r.randrange(n)}"
    for i in range(n, n + 30):  # a chain
        parent[f"Q{i}"] = f"Q{i - 1}"
    return parent


def found(spark, parent, **kw):
    links = spark.createDataFrame(list(parent.items()), "child string, parent string")
    return [tuple(r) for r in build_hierarchy(links, **kw).collect()]


@pytest.mark.parametrize("how", [{}, {"local_nodes": 45}, {"local_nodes": 20}, {"local_nodes": 1}, {"local_nodes": 0}])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_cycles(spark, how, seed):
    parent = forest(seed, 60)
    rows = found(spark, parent, **how)
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(parent)


@pytest.mark.parametrize("how", [{}, {"local_nodes": 0}])
def test_self_link_ring_and_tail(spark, how):
    parent = {"A": "A", "B": "A", "C": "D", "D": "E", "E": "C", "F": "D", "G": "F"}
    assert set(found(spark, parent, **how)) == brute(parent)


def test_links_are_cleaned(spark):
    rows = [
        ("t1", " q2 ", "P9104117", "Q1"),
        ("t2", "Q1", "P9107342", "q2\t"),
        ("t2", "Q1", "P9107342", "q2\t"),
        ("t3", "Q3", "P9104117", "Q2"),
        ("t4", None, "P9104117", "Q2"),
        ("t5", "Q4", "P9104117", "  "),
        ("t6", "Q5", None, "Q2"),
        ("t7", "Q6", "P1", "Q2"),
        (None, "Q7", "P9104117", "Q9"),
        (None, "Q7", "P9104117", "Q8"),
    ]
    links = hierarchy_links(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS child", "1 AS parent"))
    assert {tuple(r) for r in links.collect()} == {("Q2", "Q1"), ("Q3", "Q2"), ("Q7", "Q8")}


def test_empty(spark):
    assert build_hierarchy(hierarchy_links(spark.createDataFrame([], SCHEMA))).collect() == []


def test_descendants(spark):
    links = spark.createDataFrame([("B", "A"), ("C", "B"), ("X", "X")], "child string, parent string")
    pairs = {tuple(r) for r in descendant_pairs(build_hierarchy(links)).collect()}
    assert pairs == {("A", "B"), ("A", "C"), ("B", "C")}


def test_deep_chain(spark):
    parent = {f"N{i:04d}": f"N{i - 1:04d}" for i in range(1, 700)}
    rows = {r[0]: r for r in found(spark, parent, local_nodes=100)}
    assert rows["N0699"][2] == 699 and rows["N0000"][4] == 699 and rows["N0350"][4] == 349


@pytest.mark.parametrize("seed", [3])
def test_rounds_to_the_end(spark, seed):
    parent = forest(seed, 90)
    assert set(found(spark, parent, local_nodes=0)) == brute(parent)


def test_a_long_cycle_and_a_long_chain_take_few_rounds(spark):
    ring = {f"R{i}": f"R{(i + 1) % 100}" for i in range(100)}
    chain = {f"C{i:03d}": f"C{i - 1:03d}" for i in range(1, 100)} | {"C000": "R7"}
    rows = {r[0]: r for r in found(spark, ring | chain, local_nodes=0)}
    assert rows["R5"] == ("R5", "R0", -1, "", 199) and rows["C050"] == ("C050", "R0", -1, "", 49) and len(rows) == 200


def test_a_second_parent_is_reported(spark):
    rows = [("t", "Q7", "P9104117", "Q9"), ("t", " q8", "P9107342", "Q7"), ("t", "Q7", "P9104117", "Q9"), ("t", "Q1", "P9104117", "Q7"), ("t", "Q7", "P5", "Q2")]
    triples = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in hierarchy_links(triples).collect()} == {("Q7", "Q8"), ("Q1", "Q7")}
    assert [tuple(r) for r in other_parents(triples).collect()] == [("Q7", "Q9")]
