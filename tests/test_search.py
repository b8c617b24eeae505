import numpy as np
import pytest

from pathloom.operators.search import exact_topk, fuse


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id string, v array<float>")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("slice_bytes", [1 << 20, 400])
def test_against_numpy(spark, metric, slice_bytes):
    r = np.random.default_rng(5)
    q = [(f"q{i}", r.normal(size=8).astype("f4")) for i in range(13)]
    c = [(f"c{i:03d}", r.normal(size=8).astype("f4")) for i in range(120)] + [("dup1", np.ones(8)), ("dup0", np.ones(8)), ("zero", np.zeros(8))]
    got = {}
    for row in exact_topk(frame(spark, q), frame(spark, c).repartition(5), 6, metric, slice_bytes=slice_bytes).collect():
        got.setdefault(row.query_id, []).append((row.rank_no, row.id, row.score))
    for name, v in q:
        v = v.astype(float)
        scores = []
        for cid, x in c:
            x = x.astype(float)
            length = np.linalg.norm(x) * np.linalg.norm(v)
            s = (v @ x / length if length else 0.0) if metric == "cosine" else 1 - ((v - x) ** 2).sum()
            scores.append((-round(s, 6) + 0.0, cid))
        want = sorted(scores)[:6]
        assert [(i, g) for i, g, _ in sorted(got[name])] == [(i, w[1]) for i, w in enumerate(want, 1)]
        assert [s for _, _, s in sorted(got[name])] == pytest.approx([-w[0] for w in want], abs=2e-6)


def test_few_and_none(spark):
    q, c = frame(spark, [("q", [1, 0])]), frame(spark, [("a", [1, 0]), ("b", [0, 1])])
    assert [(r.id, r.rank_no) for r in exact_topk(q, c, 10).orderBy("rank_no").collect()] == [("a", 1), ("b", 2)]
    assert exact_topk(q, c.limit(0), 10).collect() == [] == exact_topk(q.limit(0), c, 10).collect()
    with pytest.raises(ValueError):
        exact_topk(q, c, 1, "angle")


def test_fuse_ranks_again(spark):
    kind = "query_id string, id string, score double, rank_no int"
    a = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.5, 2), ("q", "x", 0.4, 3)], kind)
    b = spark.createDataFrame([("q", "c", 0.7, 1), ("q", "d", 0.5, 2)], kind)
    assert [(r.id, r.rank_no) for r in fuse([(a, 2), (b, 2)], 3).orderBy("rank_no").collect()] == [("a", 1), ("c", 2), ("b", 3)]
