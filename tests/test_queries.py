import duckdb
import pytest

from pathloom.plans import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    from pathlib import Path

    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    sql = queries.ORACLE_SQL.get(name)
    if sql is None:
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(rows) == text([[r[i] for i in at] for r in want.fetchall()])


def test_every_sql_has_a_query():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_variants(spark):
    df = spark.createDataFrame([("kg_triples",)], "variant string")
    assert queries.select_variant(df, "kg_triples").count() == 1
    with pytest.raises(ValueError):
        queries.select_variant(df, "other")


def test_repartitioning_changes_nothing(spark, sf_dir):
    from pathloom.operators import nested
    from pathloom.session import table

    runs = table(spark, sf_dir, "path_runs")
    assert set(nested.flatten_runs(runs).collect()) == set(nested.flatten_runs(runs.repartition(5)).collect())


def test_the_rest_stands_without_the_llm_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['pathloom.llm'] = None; import __spark_entry__ as e; assert 'p5_found' in e.queries() and 'p2_found' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
