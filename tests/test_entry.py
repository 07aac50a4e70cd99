"""The driver contract: every ledger query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from quittance import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return sorted([tuple(None if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v) for v in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, sf, db, name):
    df = queries.QUERIES[name](spark, sf)
    found = db.sql(queries.ORACLE[name])
    order = sorted(df.columns)
    assert order == sorted(found.columns)
    want = found.fetchall()
    at = [found.columns.index(c) for c in order]
    assert plain(map(tuple, df.select(*[f"`{c}`" for c in order]).collect())) == plain([tuple(r[k] for k in at) for r in want])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_rows_only(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0
