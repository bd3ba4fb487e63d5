"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os
from collections import Counter

import pytest

from spindrift.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 8)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    result = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert rows == Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
