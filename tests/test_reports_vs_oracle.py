"""Every registered report vs its DuckDB oracle on the smallest driver tables."""
import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as E
from shopstar.plans import registry
from shopstar.sources.tables import DRIVER_TABLES
from conftest import SF_SMALL

QUERIES = {k: v for k, v in E.queries().items() if k in registry.queries()}  # the warehouse's own
SQL = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


def _norm(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, decimal.Decimal):
        return str(v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_an_oracle_or_is_listed():
    missing = sorted(set(QUERIES) - set(SQL))
    # reports without SQL are documented as rows-only in the README
    assert all(m.startswith(("r0", "k0")) for m in missing), missing


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_report_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = df.collect()
    rel = duck.execute(SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(cols)
    o_rows = rel.fetchall()
    idx = [cols.index(c) for c in df.columns]
    a = sorted((tuple(_norm(v) for v in r) for r in rows), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in idx) for r in o_rows), key=repr)
    assert a == b
