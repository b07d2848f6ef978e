"""Every query with SQL gives the SQL's rows over whole tables."""

import os

import pytest

from kinweave.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def rows_of(cursor_or_df):
    out = []
    for r in cursor_or_df:
        out.append(tuple(round(v, 6) if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    df = QUERIES[name](spark, DATA)
    want = con.execute(SQL[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == sorted(df.columns)
    assert rows_of(df.select(*order).collect()) == rows_of(want.fetchall())
