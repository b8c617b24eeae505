import json

import pytest

from pathloom.sources import nodes


def claim(target=None, kind="wikibase-entityid", value=None):
    return {"mainsnak": {"datavalue": {"type": kind, "value": value if value is not None else {"id": target}}}, "rank": "normal"}


RECORD = {
    "labels": {"de": {"value": "Haus"}, "en": {"value": " house "}},
    "descriptions": {"fr": {"value": "bâtiment"}},
    "claims": {
        "P7": [claim(kind="string", value="text"), claim("Q1"), claim("Q2"), claim("Q3"), claim("Q4"), claim("Q5")],
        "P31": [{"mainsnak": {}}, claim("Q8"), claim("Q9"), claim("Q10")],
        "P2": [claim(kind="time", value={"time": "+2001"}), {"mainsnak": {"datavalue": None}}, claim("Q6")],
        "P279": [claim("Q11")],
    },
}


@pytest.fixture
def table(spark):
    rows = [
        ("Q100", json.dumps(RECORD)),
        ("Q101", json.dumps({"labels": {"de": {"value": "Tür"}}, "descriptions": {}, "claims": {"P1": [claim(f"Q{i}") for i in range(9)]}})),
        ("Q102", json.dumps({"claims": {"P1": [claim("Q5"), {"mainsnak": "odd"}, claim("Q6")], "P2": [claim("Q7")]}})),
        ("Q103", "{broken"),
        ("Q104", None),
        ("Q105", json.dumps({"labels": {"en": {"value": ""}, "es": {"value": "puerta"}}})),
    ]
    return nodes.read_nodes(spark.createDataFrame(rows, "id string, record string").selectExpr("*", "1 AS labels"))


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_labels_by_language(table):
    assert pairs(nodes.node_labels(table)) == {("Q100", "house"), ("Q101", "Tür"), ("Q102", None), ("Q103", None), ("Q104", None), ("Q105", "puerta")}
    assert dict(pairs(nodes.node_labels(table, any_language=False)))["Q101"] is None


def test_full_texts_fall_back_to_other_languages_and_the_id(table):
    got = dict(pairs(nodes.node_texts(table)))
    assert got == {"Q100": "house. bâtiment.", "Q101": "Tür. .", "Q102": "Q102", "Q103": "Q103", "Q104": "Q104", "Q105": "puerta. ."}


def test_claims_are_capped_by_position_before_their_type(table):
    got = [tuple(r) for r in nodes.capped_claims(nodes.node_claims(table)).orderBy("head", "edge_ord").collect()]
    assert [r for r in got if r[0] == "Q100"] == [
        ("Q100", "P7", "Q1", 1), ("Q100", "P7", "Q2", 2), ("Q100", "P7", "Q3", 3), ("Q100", "P7", "Q4", 4),
        ("Q100", "P31", "Q8", 5), ("Q100", "P31", "Q9", 6), ("Q100", "P31", "Q10", 7), ("Q100", "P2", "Q6", 8), ("Q100", "P279", "Q11", 9),
    ]
    assert [r[2] for r in got if r[0] == "Q101"] == ["Q0", "Q1", "Q2", "Q3", "Q4"]
    assert [r[2] for r in nodes.capped_claims(nodes.node_claims(table), per_node=3).collect() if r[0] == "Q100"] == ["Q1", "Q2", "Q3"]


def test_a_malformed_claim_does_not_cost_the_others(table):
    assert [r.tail for r in nodes.capped_claims(nodes.node_claims(table)).filter("head = 'Q102'").orderBy("edge_ord").collect()] == ["Q5", "Q6", "Q7"]


def test_type_labels(table):
    got = {r.id: r.labels for r in nodes.type_labels(nodes.node_labels(table), nodes.node_claims(table)).collect()}
    assert got["Q100"] == ["house", "Q8", "Q9", "Q11"] and got["Q102"] == ["Q102"] and got["Q101"] == ["Tür"]


def test_fetch(spark, table):
    ids = spark.createDataFrame([("Q100",), ("Q100",), ("Q999",), (None,)], "id string")
    got = {r.id: r.claims is None for r in nodes.fetch_nodes(ids, table).collect()}
    assert got == {"Q100": False, "Q999": True}
    assert nodes.node_claims(table.limit(0)).collect() == []
