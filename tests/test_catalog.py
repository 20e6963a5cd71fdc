"""Every catalogue query against its SQL on the smallest tables."""

import os

import pytest

from factloom.plans import catalog, catalog_graph, catalog_more  # noqa: F401 - registers its queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    answer = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
