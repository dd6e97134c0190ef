"""Every registered query against its SQL twin, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        p = f"{SF}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        return
    r = duck.execute(catalogue.ORACLES[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    theirs = Counter(tuple(x[cols.index(c)] for c in df.columns) for x in r.fetchall())
    assert Counter(map(tuple, rows)) == theirs
