"""Every registered query of the survey engine against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from canvass import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if hasattr(v, "tolist") and hasattr(v, "__len__"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if v is None or pd.isna(v):
        return None
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert set(df.columns) == set(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    mine = sorted((tuple(map(norm, r)) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_alike_twice(spark, name):
    q = catalog.queries()[name]
    first, second = (sorted(map(repr, q(spark, SF).collect())) for _ in range(2))
    assert first and first == second


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
