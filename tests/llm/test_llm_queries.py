import duckdb
import pytest

from pathloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert len(rows) == len({str(r) for r in rows})
    sql = queries.ORACLE_SQL.get(name)
    if sql:
        from pathlib import Path

        con = duckdb.connect()
        for p in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = con.execute(sql)
        at = [[c[0] for c in want.description].index(c) for c in df.columns]
        assert sorted(map(tuple, rows)) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
