"""The registered corpus queries against their SQL."""

from __future__ import annotations

import pytest

from tests.conftest import SF
from tests.oracle import same
from triplake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)
