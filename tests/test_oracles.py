"""Every query with SQL gives the rows of that SQL."""

import datetime
import decimal
import math

import duckdb
import pytest

from sextant.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def table(columns, rows):
    return sorted((tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, folder, name):
    df = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert df.columns
        return
    found = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, rows) == table(columns, found.fetchall())
