"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from isobar.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple("" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(key(r[c] for c in columns) for r in df.collect())
    if name in registry.SQL:
        found = duck.sql(registry.SQL[name])
        assert sorted(found.columns) == columns
        assert got == sorted(map(key, found.select(*(f'"{c}"' for c in columns)).fetchall()))
