"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lorekeep.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(value):
    if value is None or value is pd.NA or value != value:
        return "null"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(shown(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf, duck, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    for f in (got, want):
        for c in f.columns:
            if str(f[c].dtype) in ("float64", "Int64") and f[c].dropna().map(float.is_integer if str(f[c].dtype) == "float64" else lambda x: True).all():
                f[c] = f[c].astype("Int64")
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
