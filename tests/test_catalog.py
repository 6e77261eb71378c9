"""Every query against its SQL on the driver's smallest tables."""

import math
import os

import duckdb
import pytest

from tidegrid.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else f"{v:.8g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    out = tables.execute(catalog.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    assert got == sorted(str([plain(r[names.index(c)]) for c in cols]) for r in out.fetchall())
