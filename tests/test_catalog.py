"""Every registered query gives the rows of its SQL."""

import glob
import math
import os

import duckdb
import pytest

from tessergraph.plans import catalog, details  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, v if isinstance(v, (int, float)) else 0, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    result = con.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = ordered([tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()])
    assert got == want


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_routes(spark):
    routes = [r["route"] for r in catalog.ask_route(spark, SF).collect()]
    assert routes == ["kq1", "kq2", "kq3", "kq4", "neighbors", "enumerate", "aggregate", "get_entity", "search", "unknown"]
