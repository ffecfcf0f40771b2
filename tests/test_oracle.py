import pytest
from oracle import same

from palimpsest import queries as core


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_equals_sql(spark, sf, name):
    same(core.queries()[name](spark, sf), core.oracle_sql()[name], sf)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
