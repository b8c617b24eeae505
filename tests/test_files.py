import json

import numpy as np
import pytest

from pathloom.session import fits_broadcast
from pathloom.sources import catalog, files


def test_entries(spark, tmp_path):
    (tmp_path / "e.txt").write_text("Q1\tone\nno tab\nQ2\ttwo\tmore\n\n  Q3\tthree  \n")
    assert sorted(tuple(r) for r in files.read_entries(spark, str(tmp_path / "e.txt")).collect()) == [("Q1", "one"), ("Q2", "two more"), ("Q3", "three")]


def test_matrix_and_chunks(spark, tmp_path):
    for n, size in ((2, 3), (10, 2)):
        np.save(tmp_path / f"embeddings_chunk_{n}.npy", np.full((size, 4), n, dtype=np.float32))
        lines = [json.dumps({"head_id": f"Q{n}{i}"}) for i in range(size)]
        (tmp_path / f"metadata_chunk_{n}.json").write_text("\n".join(lines))
    v = [str(tmp_path / f"embeddings_chunk_{n}.npy") for n in (10, 2)]
    m = [str(tmp_path / f"metadata_chunk_{n}.json") for n in (2, 10)]
    rows = sorted((r.chunk, r.row, r.head_id, r.v[0]) for r in files.read_chunks(spark, v, m).collect())
    assert rows == [(2, 0, "Q20", 2.0), (2, 1, "Q21", 2.0), (2, 2, "Q22", 2.0), (10, 0, "Q100", 10.0), (10, 1, "Q101", 10.0)]
    with pytest.raises(ValueError):
        files.read_chunks(spark, v, m[:1])
    np.save(tmp_path / "embeddings_chunk_2.npy", np.zeros((5, 4), dtype=np.float32))
    with pytest.raises(ValueError):
        files.read_chunks(spark, v, m)
    with pytest.raises(ValueError):
        files.chunk_number("plain.npy")


def test_row_numbers(spark):
    df = spark.range(1000).selectExpr("cast(999 - id as string) as id").repartition(7)
    rows = {r.id: r.i for r in files.index_rows(df, ["id"]).collect()}
    assert rows == {x: i for i, x in enumerate(sorted(rows))}
    assert files.index_rows(df.limit(0), ["id"]).collect() == []


def test_collections(spark, tmp_path):
    df = spark.createDataFrame([("b", "x"), ("a", "z"), ("a", "y")], "collection string, id string")
    assert {(r.id, r.row_id) for r in files.collection_rows(df).collect()} == {("x", "b_0"), ("y", "a_0"), ("z", "a_1")}
    path = str(tmp_path / "c")
    v = spark.createDataFrame([("x", [1.0])], "id string, embedding array<float>")
    files.write_collection(v, path)
    files.write_collection(v, path)
    assert spark.read.parquet(path).count() == 2
    files.write_collection(v, path, "overwrite")
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(ValueError):
        files.write_collection(v.drop("embedding"), path)


def test_sheets_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("q1", 'two\nlines, "quoted"')], "question_id string, question string")
    files.write_csv(df, str(tmp_path / "s.csv"))
    assert files.read_sheet(spark, str(tmp_path / "s.csv")).collect() == df.collect()
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    ranked = spark.createDataFrame([("q", "P1", "to", 0.5, 2), ("q", "P2", None, 0.25, 1)], "question_id string, id string, text string, score double, rank_no int")
    assert files.similarity_report(ranked).first().report == "- P2:  (Score: 0.2500)\n- P1: to (Score: 0.5000)"
    files.write_report(ranked, str(tmp_path / "r"))
    assert "=" * 80 in "".join(p.read_text() for p in (tmp_path / "r").glob("part*"))


def test_registry(spark):
    with pytest.raises(ValueError):
        catalog.dataset(spark, "/nowhere", "other")


def test_size_check(spark):
    assert fits_broadcast(spark.range(10), 8, 80) and not fits_broadcast(spark.range(11), 8, 80)
