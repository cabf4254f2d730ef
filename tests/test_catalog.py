import pytest
from tests.conftest import SF, same_rows

import __spark_entry__
from feedloop.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, SF), duck.execute(catalog.SQL[name]))


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    out = __spark_entry__.entry(spark)
    assert set(out.columns) == {"run", "point", "recall", "evenness"} and out.count() > 0
