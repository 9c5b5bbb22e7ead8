"""Every query against its SQL on the smallest tables."""

import pytest
from tests.conftest import duck, same

from factweave.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, sf, name):
    assert same(Q.QUERIES[name](spark, sf), duck(Q.SQL[name], sf))


def test_entry_works_without_the_other_folder(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "hadm_id"
    assert set(Q.QUERIES) <= set(__spark_entry__.queries())
