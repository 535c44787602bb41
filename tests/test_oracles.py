"""Every registered query of the engine against its SQL twin in DuckDB, on the smallest driver tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from vigil.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:  # fitted models
        assert name == "boosted_scores" and got and all(0 <= r.score <= 1 for r in got)
        return
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    pick = [names.index(c) for c in df.columns]
    want = sorted(tuple(norm(r[i]) for i in pick) for r in cursor.fetchall())
    assert sorted(tuple(norm(v) for v in r) for r in got) == want
