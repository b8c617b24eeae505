"""The bound that a tile uses holds for the product that it uses; cells grow below the number of candidates."""

import numpy as np
import pytest

from pathloom.llm import vector_topk as vt


@pytest.mark.parametrize("dims", [8, 64, 768, 1024])
@pytest.mark.parametrize("seed", [0, 1])
def test_products_are_within_their_slack(dims, seed):
    r = np.random.default_rng(seed)
    x, q = vt._unit(r.normal(size=(300, dims)) ** 3), vt._unit(r.normal(size=(90, dims)))
    codes, scale, left = vt._quantised(x)
    q_codes, q_scale, q_left = vt._quantised(q)
    rough = vt._products(q_codes, np.ascontiguousarray(codes.T, dtype=np.float32), scale.astype(np.float32))
    slack = vt._slack(q_scale, q_left, float(left.max()), 6)
    assert (np.abs(np.round(q @ x.T, 6) / q_scale[:, None] - rough) <= slack[:, None]).all()
    exact = q_codes.astype(np.int64) @ codes.T.astype(np.int64)
    assert np.array_equal(q_codes.astype(np.float32) @ codes.T.astype(np.float32), exact)


def test_cells_grow_with_the_candidates():
    n = [vt.cell_number(c) for c in (1, 1500, 6_000_000, 24_576_000, 600_000_000)]
    assert n == [1, 1, 4000, 8192, 40477]
    assert all(a <= b for a, b in zip(n, n[1:]))


def test_many_cells_stay_exact_and_small_matrices_do(spark, monkeypatch):
    from test_vector_topk import KIND, brute, lists, make

    monkeypatch.setattr(vt, "FIRST_CELLS", 4)
    monkeypatch.setattr(vt, "MATRIX", 50)
    rows = make(5)
    assert lists(vt.nearest(spark.createDataFrame(rows, KIND), probes=None, cell_rows=10)) == brute(rows)
