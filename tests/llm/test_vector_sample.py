import numpy as np

from pathloom.llm import vector_topk as vt


def test_centroids_differ_where_one_vector_is_sampled_often():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 64)).astype("f4")
    x[::3] = x[0] * r.uniform(0.5, 4, size=(134, 1)).astype("f4")
    c = vt.fit_centroids(x, 60)
    assert len(c) == len(np.unique(np.round(c, 4), axis=0)) > 40


def test_the_sample_holds_each_vector_once(spark, monkeypatch):
    seen = []
    fit = vt.fit_centroids
    monkeypatch.setattr(vt, "fit_centroids", lambda sample, cells: seen.append((sample.copy(), cells)) or fit(sample, cells))
    r = np.random.default_rng(2)
    rows = [("entities", f"Q{i}", r.normal(size=64).tolist()) for i in range(90)]
    rows += [("entities", f"X{i}", rows[0][2]) for i in range(60)]
    vt.nearest(spark.createDataFrame(rows, "collection string, id string, embedding array<float>"), cell_rows=10)
    sample, cells = seen[0]
    assert cells == 9 and len(sample) == len(np.unique(sample, axis=0)) == 90
