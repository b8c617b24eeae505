import pytest
from pyspark.sql import functions as F

from pathloom.functions import metrics, text, vectors
from pathloom.operators import matching


def values(spark, rows, kind, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, kind).select(*exprs).collect()]


def test_first_digit_is_the_label(spark):
    replies = [("1",), ("label: 0",), ("10",), ("Attribute 1 is",), ("yes",), ("",), (None,), ("x" * 100_000 + "0",)]
    assert [v[0] for v in values(spark, replies, "r string", text.extract_label(F.col("r")))] == [1, 0, 1, 1, -1, -1, -1, 0]


def test_metrics(spark):
    def of(rows):
        return [round(x, 4) for x in metrics.match_metrics(spark.createDataFrame(rows, "label int, prediction int")).first()]

    assert of([(1, 1), (1, 0), (0, 1), (0, 0)]) == [0.5, 0.5, 0.5, 0.5, 1.0]
    assert of([]) == [0, 0, 0, 0, 0]
    assert of([(1, 0), (0, 0)]) == [0, 0, 0, 0.5, 1.0]
    assert of([(1, 1), (1, -1), (None, 1), (0, None)]) == [1, 1, 1, 1, round(1 / 3, 4)]


def test_question_keeps_its_layout(spark):
    q = text.generate_question(*map(F.col, "abcd"))
    got = values(spark, [("s", None, "t", "y")], "a string, b string, c string, d string", q)[0][0]
    assert got.split("\n") == [
        "Attribute 1 s and its description 1 nan ", "Attribute 2 t and its description 2 y ",
        "Do attribute 1 and attribute 2 are semantically matched with each other?",
    ]


def test_cells(spark):
    rows = [(" Q1, x, ,Q2 \n",), (None,), ("",)]
    assert values(spark, rows, "c string", text.parse_entity_cell(F.col("c"))) == [(["Q1", "Q2"],), (None,), ([],)]
    assert values(spark, [("a, null, ,b",)], "c string", text.parse_mentions(F.col("c"))) == [(["a", "b"],)]
    assert values(spark, [("a, b | | c|null",)], "c string", text.parse_llm_paths(F.col("c"))) == [(["a, b", "c"],)]
    cells = [(None,), ("x",), ('["a", "b"]',), ("[broken",), ("",)]
    assert values(spark, cells, "c string", text.normalise_paths(F.col("c"))) == [([],), (["x"],), (["a", "b"],), (["[broken"],), ([""],)]


def test_ids(spark):
    ids = [("Q12",), ("P3",), ("q1",), ("Q1x",), ("",), (None,)]
    assert [v[0] for v in values(spark, ids, "i string", text.is_valid_id(F.col("i")))] == [True, True, False, False, False, None]
    uris = [("http://h/prop/direct/P5",), ("http://h/entity/Q7",), ("http://h/entity/L7",), ("http://h/entity/Q7/x",), (None,)]
    assert [v[0] for v in values(spark, uris, "u string", text.uri_to_id(F.col("u")))] == ["P5", "Q7", None, None, None]


def test_prompts(spark):
    rows = [("q", "a path"), ("q", None), ("q", ""), ("q", "null")]
    got = [v[0] for v in values(spark, rows, "q string, p string", text.kg_prompt(F.col("q"), F.col("p")))]
    assert "a path" in got[0] and all(text.NO_CONTEXT in g for g in got[1:])


def test_full_text(spark):
    rows = [("a", "b", "Q1"), ("a", None, "Q1"), (None, " ", "Q1")]
    assert [v[0] for v in values(spark, rows, "l string, d string, i string", text.full_text(F.col("l"), F.col("d"), F.col("i")))] == ["a. b.", "a. .", "Q1"]


def test_vectors(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],)]
    safe = values(spark, rows, "v array<float>", vectors.l2_normalize_safe(F.col("v")))
    assert safe[0][0] == pytest.approx([0.6, 0.8]) and safe[1][0] == [0.0, 0.0]
    plain = values(spark, rows, "v array<float>", vectors.l2_normalize(F.col("v")))
    assert plain[0][0] == pytest.approx([0.6, 0.8]) and all(x != x for x in plain[1][0])
    bad = [([1.0, None],), ([1.0],), (None,), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([0.0, 0.0],), ([1.0, 0.0],)]
    assert [v[0] for v in values(spark, bad, "v array<float>", vectors.usable(F.col("v"), 2))] == [False] * 6 + [True]
    unit = values(spark, [("x",), (None,)], "t string", vectors.norm(vectors.hash_embed(F.col("t"))))
    assert [u[0] for u in unit] == pytest.approx([1.0, 1.0])


def test_responder(spark):
    rows = [(1, "First attribute a-key_x \nSecond b-key_y", "left"), (2, "a-one b-two", "x"), (3, None, "x")]
    asked = spark.createDataFrame(rows, "id int, prompt string, reply string")
    assert [(r.id, r.reply) for r in matching.respond(asked, "s").orderBy("id").collect()] == [(1, "1"), (2, "0"), (3, None)]

    def failing():
        def call(system, prompts):
            raise RuntimeError("no answer")

        return call

    matching.register_responder("failing", failing)
    assert {r.reply for r in matching.respond(asked, "s", "failing").collect()} == {None}
    with pytest.raises(ValueError):
        matching.respond(asked, "s", "nobody")
    got = matching.predict(spark.createDataFrame([("First a-key_x, second b-key_y", None)], "question string, paths string"), paths="paths")
    assert got.first().prediction == 1
