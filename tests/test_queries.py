"""Every query with SQL gives the SQL's rows over whole tables; the others give rows."""

import os

import pytest
from pyspark.sql import functions as F

from kinweave.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows_of(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name not in SQL:
        assert df.count() > 0
        return
    want = con.execute(SQL[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == sorted(df.columns)
    want = rows_of(want.fetchall())
    assert want
    assert rows_of(df.select(*order).collect()) == want


def test_fasta_file_of_many_files(spark, tmp_path):
    """Files of a table that do not go by id, the largest last: numbers still go by id."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    last = docs.agg(F.max("doc_id")).first()[0]
    for rows in (docs.where(F.col("doc_id") > last // 2), docs.where(F.col("doc_id") <= last // 8), docs.where((F.col("doc_id") <= last // 2) & (F.col("doc_id") > last // 8))):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["fasta_file"](spark, str(tmp_path)).collect()
    assert rows_of(got) == rows_of(QUERIES["fasta_parse"](spark, DATA).collect())
