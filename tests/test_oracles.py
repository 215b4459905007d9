"""Every frame query against its DuckDB SQL, as value-by-value multisets."""

import os

import duckdb
import pandas as pd
import pytest

from framequery.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


def rows(df, columns):
    def one(v):
        if pd.isna(v):
            return "NULL"
        return f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    # A value on a rounding edge may fall either way in its last place.
    for x, y in wrong:
        for p, q in zip(x, y):
            assert p == q or abs(float(p) - float(q)) <= 2e-5, (x, y)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
