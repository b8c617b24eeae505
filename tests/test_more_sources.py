import json
import logging
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom import runlog, session
from pathloom.functions import vectors as vx
from pathloom.operators import matching
from pathloom.sources import files, sheets


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = [("a", 1, 2.5, "line\r\nbreak & <tag>", True), ("ü🙂", None, None, "", None), (None, -3, 0.0, "_x0041_ \x07 \t end ", False)]
SHEET = "name string, n bigint, x double, t string, b boolean"


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    df = spark.createDataFrame(ODD, SHEET)
    sheets.write_workbook(df, path)
    got = {r["n"]: tuple(r) for r in files.read_sheet(spark, path, SHEET).collect()}
    want = {r[1]: r for r in ODD} | {None: ("ü🙂", None, None, "", None)}
    assert got == want
    assert files.read_sheet(spark, path).columns == ["name", "n", "x", "t", "b"]
    assert [r["t"] for r in files.read_sheet(spark, path, "t string").filter("t like 'line%'").collect()] == ["line\r\nbreak & <tag>"]
    with pytest.raises(Exception, match="missing columns: other"):
        files.read_sheet(spark, path, "other string").collect()
    added = str(tmp_path / "b.xlsx")
    sheets.write_workbook(files.read_sheet(spark, path, "name string, n int").withColumn("question", F.concat(F.lit("q\n"), "name")), added)
    assert rows(files.read_entries(spark, added)) == [("question_0", "q\na"), ("question_1", "q\nü🙂"), ("question_2", None)]
    assert len(files.read_entries(spark, added, limit=2).collect()) == 2
    sheets.write_workbook(df.limit(0), path)
    assert files.read_sheet(spark, path, SHEET).collect() == []


def test_limit_counts_lines_that_are_no_entry(spark, tmp_path):
    (tmp_path / "e.txt").write_text("no tab\nQ1\tone\nQ2\ttwo\n")
    assert rows(files.read_entries(spark, str(tmp_path / "e.txt"), limit=2)) == [("Q1", "one")]


def test_matrix_and_sidecar_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"q{i:02d}", f"text\t{i}\nmore" if i else None, [float(i), 1.0]) for i in range(25)], "id string, text string, v array<float>")
    assert files.write_matrix(df, str(tmp_path / "m"), chunk_rows=10) == 3
    got = []
    for n in range(3):
        v = {r.row: list(r.v) for r in files.read_matrix(spark, str(tmp_path / "m" / f"embeddings_chunk_{n}.npy")).collect()}
        meta = files.read_metadata(spark, str(tmp_path / "m" / f"embeddings_chunk_{n}.txt")).collect()
        got += [(r.id, r.text, v[r.row]) for r in sorted(meta, key=lambda r: r.row)]
    assert got == [(f"q{i:02d}", f"text {i} more" if i else "", [float(i), 1.0]) for i in range(25)]
    (tmp_path / "odd.txt").write_text("Q1\ta\tb\nno tab\n\nQ2\tc\n")
    assert [tuple(r) for r in files.read_metadata(spark, str(tmp_path / "odd.txt")).orderBy("row").collect()] == [(0, "Q1", "a\tb"), (1, "no tab", None), (2, "", None), (3, "Q2", "c")]


def test_named_pairs(spark, tmp_path):
    for name, n in (("one", 2), ("two", 3)):
        np.save(tmp_path / f"{name}.npy", np.full((n, 2), n, dtype=np.float32))
        (tmp_path / f"{name}.json").write_text(json.dumps([{"head_id": f"{name}{i}"} for i in range(n)]))
    pairs = {n: (str(tmp_path / f"{n}.npy"), str(tmp_path / f"{n}.json")) for n in ("one", "two")}
    got = files.read_named(spark, pairs).orderBy("part", "row").select("part", "row", "head_id", F.col("v")[0]).collect()
    assert [tuple(r) for r in got] == [(0, 0, "one0", 2.0), (0, 1, "one1", 2.0), (1, 0, "two0", 3.0), (1, 1, "two1", 3.0), (1, 2, "two2", 3.0)]
    with pytest.raises(FileNotFoundError, match="three"):
        files.read_named(spark, pairs | {"three": (str(tmp_path / "none.npy"), pairs["one"][1])})


@pytest.mark.parametrize("wrap", [lambda r: r, lambda r: {"results": r}])
def test_result_files(spark, tmp_path, wrap):
    path = str(tmp_path / "r.json")
    record = {"question_id": "q1", "raw_paths": [[["entity", "Q1"]]], "paths": "A (Q1)"}
    (tmp_path / "r.json").write_text(json.dumps(wrap([record, {"paths": []}]), indent=1))
    assert [(r.question_id, json.loads(r.record)) for r in files.read_results(spark, path).collect()] == [("q1", record)]
    (tmp_path / "r.json").write_text(json.dumps(wrap({"q1": record, "q2": "No path found", "q3": {"raw_paths": "x", "paths": ["a", "b"]}})))
    got = {r.question_id: ([json.loads(x) if x[0] == "[" else x for x in r.raw_paths], r.paths) for r in files.read_paths(spark, path).collect()}
    assert got == {"q1": ([[["entity", "Q1"]]], ["A (Q1)"]), "q2": ([], ["No path found"]), "q3": (["x"], ["a", "b"])}


def test_upsert_and_collection(spark, tmp_path):
    path = str(tmp_path / "c")
    kind = "id string, document string, embedding array<float>"
    files.upsert_collection(spark.createDataFrame([("a", "1", [1.0]), ("b", "1", [1.0])], kind), path)
    files.upsert_collection(spark.createDataFrame([("b", "2", [2.0]), ("b", "2", [2.0]), ("c", "2", [2.0])], kind), path)
    assert rows(files.read_collection(spark, path).select("id", "document")) == [("a", "1"), ("b", "2"), ("c", "2")]
    assert [p.name for p in tmp_path.iterdir()] == ["c"]
    with pytest.raises(ValueError):
        files.upsert_collection(spark.createDataFrame([("a",)], "id string"), path)


def test_small_row_operators(spark):
    df = spark.createDataFrame([("q", 1, "a"), ("q", 3, "b"), ("q", 3, "c"), ("r", 2, None), (None, 1, "x")], "k string, at int, v string")
    assert rows(files.last_wins(df, ["k"], ["at"])) == sorted([("q", 3, "c"), ("r", 2, None), (None, 1, "x")], key=str)
    assert [r.at for r in files.first_rows(df, ["at", "v"], 2).collect()] == [1, 1]
    ids = spark.createDataFrame([(f"Q{i}",) for i in range(7)] + [("P1",), (None,), ("Q1",)], "id string")
    assert rows(files.id_page(ids, "Q", limit=5, page=2)) == [("Q0", 0), ("Q1", 0), ("Q2", 1), ("Q3", 1), ("Q4", 2)]


def test_entries_keep_all_parts(spark):
    line = "\t".join(["Q1", *["x"] * 5000])
    (row,) = files.parse_entries(spark.createDataFrame([(line,)], "value string")).collect()
    assert row.text == " ".join(["x"] * 5000)


def test_masked_mean(spark):
    data = [([[3.0, 0.0], [1.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[3.0, 4.0]], [0]), ([], [])]
    df = spark.createDataFrame(data, "v array<array<float>>, m array<int>")
    got = [r[0] for r in df.select(vx.masked_mean(F.col("v"), F.col("m"))).collect()]
    assert got[0] == pytest.approx([2**-0.5, 2**-0.5]) and got[1] == [0.0, 0.0] and got[2] is None


def test_a_failing_prompt_says_why_and_costs_no_other(spark):
    def factory():
        def call(system, prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no luck")
            return ["1"] * len(prompts)

        return call

    matching.register_responder("picky", factory)
    df = spark.createDataFrame([("good",), ("bad",), (None,), ("fine",)], "prompt string").coalesce(1)
    got = {r.prompt: (r.reply, r.error) for r in matching.respond(df, "s", "picky").collect()}
    assert got == {"good": ("1", None), "fine": ("1", None), "bad": (None, "RuntimeError: no luck"), None: (None, None)}


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda k, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session)


def test_written_tables_can_be_discarded(spark):
    session.discard_tables(spark)
    df = session.written(spark.range(3))
    assert df.count() == 3 and session.discard_tables(spark) == 1 and session.discard_tables(spark) == 0


def test_run_log(tmp_path):
    at = datetime(2025, 1, 2, 3, 4, 5)
    log = runlog.run_log(str(tmp_path), "a/b model", "cms", now=at)
    assert runlog.run_log(str(tmp_path), "a/b model", "cms", now=at) is log and len(log.handlers) == 2
    log.info("scored %d", 3)
    logging.shutdown()
    assert "INFO scored 3" in (tmp_path / "a-b-model_cms_20250102_030405.log").read_text()
