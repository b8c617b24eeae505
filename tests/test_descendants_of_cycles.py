import pytest
from test_hierarchy import ancestors, forest

from pathloom.operators.hierarchy import build_hierarchy, descendant_pairs

RING_WITH_SUBTREE = {"C": "D", "D": "E", "E": "C", "F": "D", "G": "F", "H": "F", "X": "X", "Y": "X", "B": "A"}


@pytest.mark.parametrize("parent", [RING_WITH_SUBTREE, forest(1, 60)])
def test_descendants_on_and_below_cycles(spark, parent):
    links = spark.createDataFrame(list(parent.items()), "child string, parent string")
    hierarchy = build_hierarchy(links)
    rows = [tuple(r) for r in descendant_pairs(hierarchy, links).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(a, n) for n in parent for a in ancestors(parent, n) if a != n}
    counts = {r.node_id: r.n_descendants for r in hierarchy.collect()}
    assert counts == {n: sum(a == n for a, _ in rows) for n in counts}


def test_cycles_without_links_are_no_silent_loss(spark):
    links = spark.createDataFrame(list(RING_WITH_SUBTREE.items()), "child string, parent string")
    with pytest.raises(ValueError):
        descendant_pairs(build_hierarchy(links))
