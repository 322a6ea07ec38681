"""Every registered query of the core against its DuckDB oracle, on the smallest fixture."""

import math
import os

import duckdb
import pytest

from graphloom.plans import registered


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registered.ORACLE_SQL))
def test_oracle(spark, sf_dir, duck, name):
    df = registered.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cur = duck.execute(registered.ORACLE_SQL[name])
    own = [d[0] for d in cur.description]
    want = sorted(repr([plain(dict(zip(own, r, strict=True))[c]) for c in columns]) for r in cur.fetchall())
    assert columns == sorted(own)
    assert got == want
    assert got


@pytest.mark.parametrize("name", sorted(set(registered.QUERIES) - set(registered.ORACLE_SQL)))
def test_rows_only(spark, sf_dir, name):
    assert registered.QUERIES[name](spark, sf_dir).count() > 0


def test_clients_of_many_users(spark, tmp_path):
    """User numbers beyond 255, as larger tables have them, are still addresses."""
    events = "(SELECT i AS event_id, (i * 7919) % 200000 AS user_id FROM range(5000) t(i))"
    duckdb.sql(f"copy {events} to '{tmp_path}/events.parquet'")
    got = {(r.event_id, r.client) for r in registered.QUERIES["text_clients"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert got == set(con.execute(registered.ORACLE_SQL["text_clients"]).fetchall())
