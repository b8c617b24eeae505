"""The index against the exact search: recall, ties, sizes and empty sides."""

import numpy as np
import pytest

from pathloom.operators import search


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id string, v array<float>")


def made(seed, n, m, dims=32):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, dims))
    one = lambda: centres[int(30 * r.random() ** 2)] + 0.3 * r.normal(size=dims)
    return [(f"q{i}", one()) for i in range(m)], [(f"c{i:05d}", one()) for i in range(n)]


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.rank_no] = (r.id, r.score)
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_recall(spark, monkeypatch, metric):
    monkeypatch.setattr(search, "TILE_ROWS", 70)
    q, c = made(1, 3000, 200)
    if metric == "l2":
        q, c = ([(i, v / np.linalg.norm(v)) for i, v in rows] for rows in (q, c))
    q, c = frame(spark, q), frame(spark, c).repartition(5)
    want, got = lists(search.exact_topk(q, c, 10, metric)), lists(search.indexed_topk(q, c, 10, metric, cell_rows=60))
    assert got.keys() == want.keys() and all(set(x) == set(range(1, 11)) for x in got.values())
    found = sum(len({i for i, _ in want[n].values()} & {i for i, _ in got[n].values()}) for n in want)
    assert found / (10 * len(want)) >= 0.95


def test_all_cells_are_exact_with_ties(spark):
    q, c = made(2, 400, 40)
    c += [(f"t{i}", c[3][1]) for i in range(30)] + [("zero", np.zeros(32))]
    q, c = frame(spark, q + [("same", c[3][1])]), frame(spark, c)
    assert lists(search.indexed_topk(q, c, 7, probes=1000, cell_rows=40)) == lists(search.exact_topk(q, c, 7))


def test_all_scores_and_empty_sides(spark):
    q, c = frame(spark, [("q", [1, 0]), ("r", [1, 1])]), frame(spark, [("a", [2, 0]), ("b", [0, 3])])
    got = {(r.query_id, r.id): r.score for r in search.all_scores(q, c, decimals=4).collect()}
    assert got == {("q", "a"): 1.0, ("q", "b"): 0.0, ("r", "a"): 0.7071, ("r", "b"): 0.7071}
    none = frame(spark, [("x", [1, 0])]).limit(0)
    assert search.indexed_topk(q, none, 3).collect() == [] == search.indexed_topk(none, c, 3).collect() == search.all_scores(none, c).collect()
    assert len(search.indexed_topk(q, c, 9).collect()) == 4


def test_near_vectors_do_not_cancel(spark):
    base = np.full(64, 100.0)
    c = [(f"c{i:02d}", base + np.eye(64)[0] * i / 64) for i in range(40)]
    got = lists(search.exact_topk(frame(spark, [("q", base)]), frame(spark, c), 5, "l2"))["q"]
    assert [got[n] for n in range(1, 6)] == [(f"c{i:02d}", round(1 - (i / 64) ** 2, 6)) for i in range(5)]
