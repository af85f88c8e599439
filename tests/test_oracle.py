"""Every query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from orrery.plans.queries import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def norm(value):
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    found = con.execute(ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    want = sorted((tuple(norm(r[at.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(SF)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
