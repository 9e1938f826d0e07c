"""Every market query against its SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog, screening_queries

SF = "/root/testdata/sf0.001"
TABLES = ("events", "orders", "lineitem", "customer")


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, pd.Timestamp):
        return str(v)
    if hasattr(v, "item"):
        return plain(v.item())
    return round(v, 8) + 0.0 if isinstance(v, float) else None if v is pd.NA else v


def rows(frame):
    return sorted((tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module", autouse=True)
def one_feature_table():
    """The ten screening queries share one staged table of all features here; each makes its own elsewhere."""
    make, made = screening_queries.feature_table, {}

    def once(spark, sf_dir):
        if sf_dir not in made:
            made[sf_dir] = make(spark, sf_dir)
        return made[sf_dir]

    screening_queries.feature_table = once
    yield
    screening_queries.feature_table = make


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, (int, float)) and math.isclose(p, q, abs_tol=2e-8)) for p, q in zip(x, y)), (x, y)


def test_rows_only_queries_run(spark):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        n = catalog.queries()[name](spark, SF).count()
        assert n > 0 or "ridge" in name, name  # too few rows at this size
