"""Every query of the catalogue against its SQL on the smallest tables."""

import pytest
from conftest import SF, rows_of

from factloom.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
