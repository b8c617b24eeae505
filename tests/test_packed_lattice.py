"""The lattice decides splits that no grammar of ids can, and learning makes it better."""

import random

import pytest

from pathloom.operators.packed import Model, learn, pieces, read_values, split_packed

CITIES = "berlin paris rome madrid lisbon vienna prague oslo bern dublin".split()


def values(text, model=None):
    return [v[0] for v in read_values(text, model or Model())]


@pytest.mark.parametrize("sep", ["; ", " | ", "\n", "\t"])
def test_values_without_ids(sep):
    assert values(sep.join(["Berlin", "Paris", "Rome"])) == ["Berlin", "Paris", "Rome"]


def test_pieces_and_their_delimiters():
    assert pieces("a, b (Q1), c (P1)--> d (Q2) ->")[:2] == ("XEPEX", " ,,>>")
    assert pieces("Q1;Q2\r\n<a, b, c> <d>")[:2] == ("BBTX", " ;n ")
    assert pieces("") == ("", "", [], []) == pieces(" ;, ")


def test_a_list_mark_of_any_number_is_no_part_of_a_value():
    assert values("12345) bed list (Q1)\n12346) ward (Q2)") == ["bed list (Q1)", "ward (Q2)"]


def made(ids, seed=7, cells=1500):
    rnd = random.Random(seed)
    plain = list(dict.fromkeys(" ".join(rnd.sample(CITIES, rnd.randint(1, 3))) for _ in range(150)))
    inner = [f"{a}, {b}" for a, b in zip(rnd.sample(plain, 20), rnd.sample(plain, 20))]
    labels = list(dict.fromkeys(plain + inner))
    names = [f"{x} (Q{i})" for i, x in enumerate(labels)] if ids else labels
    truth = [[rnd.choice(names) for _ in range(rnd.randint(1, 5))] for _ in range(cells)]
    packed = [f'["{chr(34).join([v[0], *[", " + chr(34) + x for x in v[1:]]])}"]' if rnd.random() < 0.3 else rnd.choice([", ", "; ", " | "]).join(v) for v in truth]
    return truth, packed


@pytest.mark.parametrize("ids, least", [(True, 0.95), (False, 0.95)])
def test_learning_finds_labels_with_delimiters(spark, ids, least):
    truth, packed = made(ids)
    cells = spark.createDataFrame(list(enumerate(packed)), "pair_id bigint, f string").selectExpr("pair_id", "'' AS variant", "f")
    model = learn(cells, ["f"])["f"]
    assert model.holds() == ("entity" if ids else "any")

    def recall(m):
        return sum(len(set(values(c, m)) & set(t)) for c, t in zip(packed, truth)) / sum(len(set(t)) for t in truth)

    assert recall(model) >= least and (ids or recall(model) > recall(Model()) + 0.02)
    got = {}
    for r in split_packed(cells, {"f": "any"}).collect():
        got.setdefault(r.pair_id, {})[r.pos] = r["item"]
    assert all([got[i][n + 1] for n in range(len(got[i]))] == values(c, model) for i, c in enumerate(packed) if i in got)


def test_partitions_do_not_matter(spark):
    _, packed = made(True, cells=300)
    cells = spark.createDataFrame([(i, "", c) for i, c in enumerate(packed)], "pair_id bigint, variant string, f string")
    assert set(split_packed(cells).collect()) == set(split_packed(cells.repartition(7)).collect())


def test_what_is_kept_can_be_told(spark):
    cells = spark.createDataFrame([(1, "", "a (Q1), p (P1), b (Q2); c (Q3); note")], "pair_id bigint, variant string, f string")
    got = lambda sort: [r["item"] for r in split_packed(cells, {"f": sort}).orderBy("pos").collect()]
    path = "a (Q1), p (P1), b (Q2)"
    assert got("any") == [path, "c (Q3)", "note"] and got("entity") == [path, "c (Q3)"] and got("path") == [path]
    with pytest.raises(ValueError):
        got("other")


def test_a_very_long_run_of_labels_is_read():
    assert len(values("; ".join(["x y"] * 3000))) == 3000
