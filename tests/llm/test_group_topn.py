import random
from collections import defaultdict

import pytest

from pathloom.llm.group_topn import top_items

KIND = "q string, r array<struct<id:string,text:string,score:double>>, grp int, bound int"


def brute(rows, n):
    best = defaultdict(dict)
    for q, items, *_ in rows:
        for item in items or []:
            if item is None:
                continue
            i, _, s = item
            if q is not None and i is not None and s is not None and s == s:
                best[q][i] = max(s, best[q].get(i, s))
    return {(q, k, i) for q, d in best.items() for k, (i, _) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:n], 1)}


def make(seed, n):
    r = random.Random(seed)
    nan = float("nan")
    rows = []
    for _ in range(n):
        q = "hot" if r.random() < 0.4 else r.choice(["a", "b", "c", None])
        items = [(r.choice([None, *(f"P{k}" for k in range(40))]), None, r.choice([None, nan, round(r.random(), 1), -1.0, float("inf")])) for _ in range(r.randrange(6))]
        rows.append((q, r.choice([items, items, items, None, []]), 1, 2))
    return rows + rows[: n // 5]


@pytest.mark.parametrize("seed, parts, limit", [(1, 1, 1 << 20), (2, 6, 1 << 20), (3, 6, 1)])
def test_against_brute_force(spark, seed, parts, limit):
    rows = make(seed, 600)
    df = spark.createDataFrame(rows, KIND).repartition(parts)
    got = [tuple(r) for r in top_items(df, "q", "r.id", "r.score", 5, broadcast_bytes=limit).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5)


def test_gathering_in_small_steps(spark, monkeypatch):
    import pathloom.llm.group_topn as g

    rows = make(4, 500)
    calls = list(g._reduce(3, g._local_best(3))(iter([])))
    assert calls == []
    monkeypatch.setattr(g, "GATHER_ROWS", 20)
    import pyarrow as pa

    def batches():
        for i in range(0, len(rows), 25):
            part = [r for r in rows[i : i + 25] if r[0] is not None and r[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.string()), pa.array([[x[0] for x in r[1]] for r in part], pa.list_(pa.string())), pa.array([[x[2] for x in r[1]] for r in part], pa.list_(pa.float64()))],
                names=["grp", "ids", "scores"],
            )

    got = {(r["grp"], r["item"]) for b in g._reduce(3, g._local_best(3))(batches()) for r in b.to_pylist()}
    assert got == {(q, i) for q, _, i in brute(rows, 3)}


def test_empty_and_null_only(spark):
    df = spark.createDataFrame([("q", None, 1, 1), (None, [("a", "b", 1.0)], 1, 1), ("z", [], 1, 1)], KIND)
    assert top_items(df, "q", "r.id", "r.score").collect() == []
    assert top_items(df.limit(0), "q", "r.id", "r.score").collect() == []
