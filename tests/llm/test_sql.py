import duckdb
import pytest

from refloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df, rel = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    want = {tuple(str(v) for v in r) for r in rel.select(*df.columns).fetchall()}
    assert {tuple(str(v) for v in r) for r in df.collect()} == want


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_reads_its_whole_table(spark, name):
    """A row for each document or page; packing has one for each piece, more or as many."""
    table = spark.read.parquet(f"{DATA}/{'pages' if name.startswith('op8_') else 'documents'}.parquet")
    key = table.columns[0]
    got = queries.QUERIES[name](spark, DATA).cache()
    assert got.select(key).distinct().count() == table.count()
    assert got.count() == table.count() or name.startswith("op7_")
    got.unpersist()
