import json

import nested_by_hand as hand
import pytest

from pathloom.operators import nested

STEPS = [["entity", "Q1"], ["predicate", "P1"], ["entity", "Q2"]]
MAPS = [{"kind": "entity", "id": "Q1"}, {"kind": "predicate", "id": "P1"}, {"kind": "entity", "id": "Q2"}]
REFS = [{"kind": k, "ref": {"id": i, "label": None}} for k, i in STEPS]
WANT = [("entity", "Q1"), ("predicate", "P1"), ("entity", "Q2")]



def evaluate(spark, texts, expression):
    """The expression's value for each text; rows become tuples."""
    plain = lambda v: [plain(x) for x in v] if isinstance(v, list) else tuple(map(plain, v)) if isinstance(v, tuple) else v
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", expression.alias("v"))
    return [plain(r["v"]) for r in sorted(df.collect(), key=lambda r: r["i"])]


def text_of(value):
    return value if value is None or isinstance(value, str) else json.dumps(value)


def paths_of(spark, values):
    from pyspark.sql import functions as F

    return evaluate(spark, map(text_of, values), nested.raw_paths(F.col("t")))


def test_paths_in_every_shape(spark):
    wraps = [lambda s: [s, s], lambda s: {"b": s, "a": s}, lambda s: json.dumps([s, s]), lambda s: [json.dumps(s), s]]
    values = [wrap(steps) for steps in (STEPS, MAPS, REFS) for wrap in wraps]
    assert paths_of(spark, values) == [[WANT, WANT]] * len(values) == [hand.raw_paths(v) for v in values]


def test_single_path(spark):
    values = [v for steps in (STEPS, MAPS, REFS) for v in (steps, json.dumps(steps), json.dumps(json.dumps(steps)))]
    assert paths_of(spark, values) == [[WANT]] * len(values)
    assert paths_of(spark, [STEPS[0], MAPS[0], {"entity": "Q1"}]) == [[WANT[:1]]] * 3


def test_no_paths(spark):
    values = [None, "", [], {}, "null", "no json", 3, "[]", "[", "[1] 2", '"', '"x']
    assert paths_of(spark, values) == [[]] * len(values)


def test_order_of_a_map_is_kept(spark):
    value = {str(n): [["entity", f"Q{n}"]] for n in (10, 9, 2, 1)}
    assert paths_of(spark, [value]) == [[[("entity", f"Q{n}")] for n in (10, 9, 2, 1)]]


def test_empty_paths_count_and_other_values_do_not(spark):
    assert paths_of(spark, [[[], None, 3, STEPS[:1], "[]"]]) == [[[], WANT[:1], []]]


def test_runs_in_every_shape(spark):
    from pyspark.sql import functions as F

    record = {"question_id": "q1", "raw_paths": [STEPS]}
    as_list, as_map = [record], {"q1": {"raw_paths": [STEPS]}}
    values = (as_list, as_map, {"results": as_list}, {"results": as_map}, record, {"results": {"results": json.dumps({"results": as_list})}})
    texts = [t for v in values for t in (json.dumps(v), json.dumps(json.dumps(v)), json.dumps(v, indent=1))]
    run = nested.questions(F.col("t"))
    assert evaluate(spark, texts, run) == [[("q1", [WANT])]] * len(texts)
    none = [json.dumps({"q1": "No path found", "q2": None}), None, "{", "7", "", '{"results": null}', "[3, null]"]
    assert evaluate(spark, none, run) == [[]] * len(none)


@pytest.mark.parametrize("times", [1, 2, 3, 5, 7])
def test_text_encoded_many_times(spark, times):
    from pyspark.sql import functions as F

    text = [{"question_id": "q1", "raw_paths": [STEPS]}]
    for _ in range(times):
        text = json.dumps(text)
    assert evaluate(spark, [text], nested.questions(F.col("t"))) == [[("q1", [WANT])]]


def test_number_at_any_level(spark):
    from pyspark.sql import functions as F

    cases = [
        ({"max_hops": 3}, 3), ({"max_hops": "2"}, 2), ({"a": {"b": [{"max_hops": 1}]}}, 1), ({"max_hops": "x", "c": {"max_hops": 4}}, 4),
        ({}, None), (None, None), ({"max_hops": True}, None), ({"max_hops": "+-3"}, None), ({"max_hops": " +3 "}, 3), ({"max_hops": 2.0}, 2),
        ({"max_hops": 2.5}, None), ({"max_hops": 10**12}, None), ({"max_hops": -(2**31)}, None), ([{"max_hops": 2}], 2), ("", None), ("{", None),
    ]
    got = evaluate(spark, [text_of(v) for v, _ in cases], nested.find_number(F.col("t"), "max_hops"))
    assert got == [want for _, want in cases]


def test_very_deep_records(spark):
    deep = "[" * 20_000 + "]" * 20_000
    results = f'[{{"question_id": "q1", "extra": {deep}, "raw_paths": [[["entity", "Q1"]]]}}]'
    runs = spark.createDataFrame([(1, '{"max_hops": 1}', results), (2, "{}", deep)], "run_id bigint, metadata string, results string")
    assert [tuple(r) for r in nested.flatten_runs(runs).collect()] == [(1, 1, 1, "q1", 1, 1, "entity", "Q1")]


def test_ids_that_are_numbers(spark):
    assert paths_of(spark, [[[["entity", 7], {"predicate": 8}]]]) == [[[("entity", "7"), ("predicate", "8")]]]


def test_flat_tables(spark):
    results = json.dumps([{"question_id": "q1", "raw_paths": [STEPS, MAPS[:1]]}, {"question_id": "q2"}, {"raw_paths": [STEPS]}])
    rows = [(1, '{"max_hops": 2}', results), (1, '{"max_hops": 2}', results), (2, None, None), (3, "{", "{broken"), (4, "{}", "[]"), (None, None, results)]
    runs = spark.createDataFrame(rows, "run_id bigint, metadata string, results string").selectExpr("*", "1 AS kind", "'x' AS path_no")
    steps = {tuple(r) for r in nested.flatten_runs(runs).filter("run_id = 1").collect()}
    assert steps == {
        (1, 2, 1, "q1", 1, 1, "entity", "Q1"), (1, 2, 1, "q1", 1, 2, "predicate", "P1"), (1, 2, 1, "q1", 1, 3, "entity", "Q2"),
        (1, 2, 1, "q1", 2, 1, "entity", "Q1"),
        (1, 2, 3, None, 1, 1, "entity", "Q1"), (1, 2, 3, None, 1, 2, "predicate", "P1"), (1, 2, 3, None, 1, 3, "entity", "Q2"),
    }
    assert {tuple(r) for r in nested.flatten_runs(runs, "runs").collect()} == {(1, 2), (2, -1), (3, -1), (4, -1), (None, -1)}
    assert nested.flatten_runs(runs, "questions").filter("run_id = 1").count() == 3
    assert {tuple(r) for r in nested.flatten_runs(runs, "paths").filter("run_id = 1").select("question_no", "path_no", "n_steps").collect()} == {(1, 1, 3), (1, 2, 1), (3, 1, 3)}
    assert nested.flatten_runs(runs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        nested.flatten_runs(runs, "rows")


def test_broken_unicode(spark):
    results = '[{"question_id": "q\\ud83d", "raw_paths": [["entity", "Q\\ud83d\\ude42"]]}]'
    runs = spark.createDataFrame([(1, "{}", results)], "run_id bigint, metadata string, results string")
    assert [(r.question_id, r.member_id) for r in nested.flatten_runs(runs).collect()] == [("q\ufffd", "Q🙂")]


def test_long_run(spark):
    results = json.dumps({f"q{i}": {"raw_paths": [STEPS] * 20} for i in range(300)})
    runs = spark.createDataFrame([(1, "{}", results)], "run_id bigint, metadata string, results string")
    assert nested.flatten_runs(runs).count() == 300 * 20 * 3
