"""The queries with SQL give DuckDB's rows on the smallest data."""

import os

import duckdb
import pytest

from shopstream.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def text(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - {"op4_every_line"}))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(text(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(text(v) for v in r) for r in df.select(*columns).collect()) == want


def test_names_and_sql_agree():
    assert set(oracle_sql()) <= set(queries())
    assert queries()["op4_every_line"] is queries()["op4_lines"] and oracle_sql()["op4_every_line"] == oracle_sql()["op4_lines"]
