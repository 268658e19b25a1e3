"""Every query against its SQL twin; queries without one run and keep their schema."""

import pytest
from compare import assert_same

from lectern.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    assert_same(catalogue.QUERIES[name](spark, sf_dir), duck.sql(catalogue.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
