"""Operators against rows worked out by hand, which share no table or pattern with them."""

import pytest
from tests.golden_rows import CASES


@pytest.mark.parametrize("name", sorted(CASES))
def test_golden_rows(spark, name):
    got, want = CASES[name](spark)
    assert sorted(got, key=str) == sorted(want, key=str)
