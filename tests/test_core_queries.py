"""Every query with an oracle gives its rows; the others run and give rows."""

from __future__ import annotations

import pytest

from factloom.plans.queries import ORACLE, QUERIES

from .oracle import duck, duck_rows, spark_rows


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_oracle(spark, sf, con, name):
    assert spark_rows(QUERIES[name](spark, sf)) == duck_rows(con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry_is_stable(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["listing_id", "score", "place"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
