"""Every query of the library against its SQL twin."""

import pytest

from leadloom.plans import catalogue

from .conftest import same

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, data, name):
    assert same(catalogue.queries()[name](spark, data).toPandas(), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_rows(spark, data, name):
    assert catalogue.queries()[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
