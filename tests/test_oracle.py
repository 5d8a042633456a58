"""Every query that has a SQL twin gives the same rows as DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from rankloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return (0, str(x))
    if isinstance(x, (int, float)) or x.__class__.__name__ == "Decimal":
        return (1, "nan") if isinstance(x, float) and math.isnan(x) else (1, round(float(x), 5) + 0.0)
    return (2, str(x))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_twin(name, spark, sf, duck):
    got = catalogue.queries()[name](spark, sf)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    key = lambda r: [plain(x) for x in r]
    a = sorted((key([r[c] for c in order]) for r in got.collect()), key=str)
    b = sorted((key([r[columns.index(c)] for c in order]) for r in want.fetchall()), key=str)
    assert a == b
    assert a, "a query that finds nothing shows nothing"


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows_only(name, spark, sf):
    assert catalogue.queries()[name](spark, sf).count() > 0
