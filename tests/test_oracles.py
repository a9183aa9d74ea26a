"""Every registered query against its SQL oracle, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import pytest

from saccade.plans import registry

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_what_its_oracle_gives(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    want = duck.execute(registry.ORACLES[name])
    columns, rows = table(got.columns, got.collect())
    want_columns, want_rows = table([d[0] for d in want.description], want.fetchall())
    assert columns == want_columns
    assert len(rows) == len(want_rows) and rows == want_rows
