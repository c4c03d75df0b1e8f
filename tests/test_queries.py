"""Every quality-control query against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from readprism import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    return round(value, 9) if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("lineitem", "documents"):
        duck.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    rel = duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    key = lambda row: tuple(map(str, row))
    assert sorted([tuple(map(plain, r)) for r in df.collect()], key=key) == sorted([tuple(plain(r[i]) for i in order) for r in rel.fetchall()], key=key)


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
