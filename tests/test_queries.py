"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tiersmith.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.SQL


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in "customer supplier part orders lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(repr, r)) for r in df.select(*cols).collect())
    if name not in ORACLES:
        assert got
        return
    rel = sql.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(repr(r[i]) for i in order) for r in rel.fetchall())
