import duckdb
import pytest

from plotwright import catalog

SMALL = "/root/testdata/sf0.001"


def plain(x):
    return None if x is None or x != x else round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    from plotwright.fixtures import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalog.ORACLES:
        assert got
        return
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == columns
    want = sorted((tuple(map(plain, r)) for r in found.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)
    assert got == want


def test_entry_without_corpus_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
