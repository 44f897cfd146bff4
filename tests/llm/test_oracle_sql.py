"""Queries with SQL give DuckDB's rows."""

import duckdb
import pytest

from spectraflow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = queries.queries()[name](spark, "/root/testdata/sf0.01")
    assert sorted(got.columns) == sorted(names)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    rows = lambda values: sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in values), key=repr)
    assert rows(found.fetchall()) == rows([tuple(r[c] for c in names) for r in got.collect()])
