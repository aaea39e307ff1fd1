"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pytest

from meshframe.plans import batches, catalogue, edits, parted  # noqa: F401

SMALL = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    want = con.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(tuple("" if v is None else str(v) for v in r) for r in got.select(*columns).collect())
    other = sorted(tuple("" if v is None or v != v or str(v) == "<NA>" else str(v) for v in r) for r in want[columns].astype(object).itertuples(index=False))
    assert rows == other


def test_others_run(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.SQL):
        assert catalogue.QUERIES[name](spark, SMALL).count() > 0
