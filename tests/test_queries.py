"""Every engine query against DuckDB on the smallest driver tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from lattica import queries as Q

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not SF.exists():
        pytest.skip("no driver tables here")
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    got = Q.QUERIES[name](spark, str(SF))
    want = con.sql(Q.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    told = ", ".join('"' + c + '"' for c in columns)
    a = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    b = sorted(repr(tuple(map(plain, r))) for r in want.project(told).fetchall())
    assert a == b
