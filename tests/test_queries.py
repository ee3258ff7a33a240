"""Every query of the core against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import pytest

from tests.conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(SMALL)):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return c


def core():
    from changeloom.plans import feed, feed_sql, live, service, store, store_sql

    return {**store.QUERIES, **feed.QUERIES, **live.QUERIES, **service.QUERIES}, {**store_sql.ORACLE, **feed_sql.ORACLE, **live.ORACLE, **service.ORACLE}


@pytest.mark.parametrize("name", sorted(core()[0]))
def test_query(spark, duck, name):
    queries, oracle = core()
    df = queries[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert name in oracle, "every query of the core has SQL"
    cur = duck.execute(oracle[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
