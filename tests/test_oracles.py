"""Every query with SQL gives the SQL's rows."""

from __future__ import annotations

import pytest

from tests.conftest import SF
from tests.oracle import same
from triplake.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).columns
