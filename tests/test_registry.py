"""Registered queries against their SQL on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if not re.match(r"op\d+_", n) and n != "pipeline"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    out = entry.queries()[name](spark, sf)
    columns = sorted(out.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in out.collect())
    if name in entry.oracle_sql():
        found = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())
        assert rows == want
    else:
        assert rows


def test_training_chunks_of_copied_events(spark, duck, tmp_path):
    """Users with the same event many times over: most steps are 0, so quantiles lie between equal labels."""
    duck.execute(f"COPY (SELECT event_id + k * 1000000 AS event_id, ts, user_id, event_type, value, props FROM events, range(5) r(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    rows = [tuple(plain(v) for v in r) for r in entry.queries()["training_chunks"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(entry.oracle_sql()["training_chunks"]).fetchall()
    assert sorted(rows) == sorted(tuple(plain(v) for v in r) for r in want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
