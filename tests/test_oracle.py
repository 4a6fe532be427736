"""Every registered batch query equals its DuckDB oracle on the driver's tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from given_tables import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
BATCH = [n for n in entry.oracle_sql() if not n.startswith("stream_")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = [tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return [cols[i] for i in order], sorted(norm, key=lambda t: tuple((v is None, v or 0) for v in t))


@pytest.mark.parametrize("name", BATCH)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    cur = con.execute(entry.oracle_sql()[name])
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    want = canon([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_query_of_the_engine_has_an_oracle():
    """The corpus operators, which may be absent, have tests of their own where SQL cannot express them."""
    corpus = {n for n in entry.queries() if n == "pipeline" or re.match(r"op\d+_", n)}
    assert set(entry.queries()) - set(entry.oracle_sql()) <= corpus


def test_entry_smoke(spark):
    rows = entry.entry(spark).collect()
    assert {(r.strategy, r.bound_ms) for r in rows} == {(s, b) for s in ("key", "global")
                                                       for b in (0, 3_600_000, 21_600_000)}
    assert all(r.n_rows == 1000 for r in rows)


@pytest.mark.parametrize("name", ["key_tumbling_count", "late_split_global"])
def test_independent_of_session_time_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = entry.queries()[name](spark, SF_SMALL)
        got = canon(df.columns, [tuple(r) for r in df.collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    cur = con.execute(entry.oracle_sql()[name])
    assert got == canon([d[0] for d in cur.description], cur.fetchall())
