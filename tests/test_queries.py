"""Every registered query with an oracle against DuckDB, on the smallest tables."""

import pytest
from oracle import expected, rows

from terracefold.queries import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLES:
        assert got.columns
        got.count()
        return
    assert rows(got.toPandas()) == rows(expected(registry.ORACLES[name], SF))
