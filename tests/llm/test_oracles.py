"""The registered queries against their SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import compare  # noqa: E402

from helixmill.llm.queries import oracle_sql, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    assert compare(spark, queries()[name], oracle_sql()[name], "/root/testdata/sf0.01") > 0
