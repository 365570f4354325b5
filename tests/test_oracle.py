"""Every query with SQL against DuckDB on the smallest test tables."""

import subprocess
import sys

import duckdb
import pytest

from refloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else "~" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    rel = con.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(registry.QUERIES) <= set(e.queries()) and set(registry.SQL) <= set(e.oracle_sql())


def test_stands_without_the_llm_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("refloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(q.startswith("op") for q in e.queries()) and "pipeline" not in e.queries()
import pkgutil, refloom, importlib
for m in pkgutil.walk_packages(refloom.__path__, "refloom."):
    if not m.name.startswith("refloom.llm"):
        importlib.import_module(m.name)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
