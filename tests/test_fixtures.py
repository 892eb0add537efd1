"""Every fixture view: the Spark builder equals the DuckDB SQL over the same tables."""

import os

import duckdb
import pytest

from turnwise.sources import fixtures as FX

from .conftest import SF_SMALL
from .test_oracle import _sorted


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in FX.TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("view", sorted(FX.SQL))
def test_view_builders_equal_sql(spark, duck, view):
    df = FX.BUILDERS[view](spark, SF_SMALL)
    cols = [c for c in df.columns if c != "ts"]          # timestamps: compared through ordering only
    got = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    res = duck.execute(FX.with_views(f"select {', '.join(cols)} from {view}"))
    want = res.fetchall()
    assert _sorted(cols, got) == _sorted(cols, want)
