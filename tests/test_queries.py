"""Every query of the library's own operators runs; those with SQL give what DuckDB gives for it."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidewell.plans import registry

DATA = Path("/root/testdata/sf0.001")
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def plain(value):
    """One value in a form that both engines share; null and NaN are alike."""
    if value is None or (pd.api.types.is_scalar(value) and pd.isna(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "dtype") and getattr(value, "shape", ()) == ():
        value = value.item()
    if isinstance(value, (int, float)):
        return float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return value if isinstance(value, str) else str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    out = [tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def alike(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA)).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name not in ORACLE:
        return
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    left, right = rows(got), rows(want)
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert all(alike(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(registry.queries())
