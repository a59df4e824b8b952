"""Every registered query of the library against its SQL twin in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from heliofield.plans import registry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
KNOWN, TWINS = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in sorted(DATA.iterdir()):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_query(spark, duck, name):
    df = KNOWN[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in TWINS:
        assert rows
        return
    out = duck.execute(TWINS[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == columns
    order = lambda x: tuple((v is None, str(v)) for v in x)
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()]
    assert sorted(rows, key=order) == sorted(want, key=order)
