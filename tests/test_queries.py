"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from barloom.queries import bars, features, research

QUERIES = {k: v for m in (bars, features, research) for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in (bars, features, research) for k, v in m.ORACLES.items()}


def tidy(row):
    return tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    ran = con.execute(ORACLES[name])
    columns = [d[0] for d in ran.description]
    want = sorted((tidy(r) for r in ran.fetchall()), key=repr)
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tidy(tuple(r[c] for c in columns)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
