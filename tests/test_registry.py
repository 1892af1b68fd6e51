"""Every registered query against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from tessera.plans import registry

HEAVY = {"hybrid_search", "route_experts"}


def norm(v):
    import decimal

    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    order = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    result = duck.execute(registry.ORACLES[name])
    cols = [c[0] for c in result.description]
    assert sorted(cols) == order
    want = sorted((tuple(norm(dict(zip(cols, r, strict=True))[c]) for c in order) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs_and_repeats(spark, sf, name):
    rows = [sorted(map(tuple, registry.QUERIES[name](spark, sf).collect()), key=repr) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]
