"""The operators that SQL can express give the rows that DuckDB gives over the same tables."""

import os

import duckdb
import pytest

from loomspark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda names, rows: sorted(str([r[names.index(c)] for c in sorted(names)]) for r in rows)
    assert key(got.columns, [tuple(r) for r in got.collect()]) == key(columns, cursor.fetchall())
