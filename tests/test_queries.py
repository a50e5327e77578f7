"""Every query that SQL can express, against DuckDB on the small tables."""

import os

import duckdb
import pytest

from panelweave.plans import catalogue

SF = os.environ.get("PANELWEAVE_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    return round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF), duck.sql(catalogue.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda r: tuple(str(x) for x in r)
    a = sorted((tuple(map(norm, r)) for r in got.select(*cols).collect()), key=key)
    b = sorted((tuple(map(norm, r)) for r in want.select(", ".join(f'"{c}"' for c in cols)).fetchall()), key=key)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_without_sql_gives_rows(spark, name):
    got = catalogue.queries()[name](spark, SF)
    assert got.columns and got.collect()
