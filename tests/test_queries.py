"""Every query with an oracle against DuckDB on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from scriptloom.registry import all_oracles, all_queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return "NaN" if v != v else v + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_sql(spark, oracle, name):
    got = all_queries()[name](spark, DATA)
    want = oracle.execute(all_oracles()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda row: str(row)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_query_runs(spark, name):
    # The smallest tables have too few suppliers to split.
    folder = DATA.replace("0.001", "0.01") if name == "paired_compare" else DATA
    assert all_queries()[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
