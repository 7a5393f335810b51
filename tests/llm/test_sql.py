"""Queries of the subpackage that have SQL, against it."""

import pytest
from compare import difference, duck

from timberline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name, sf):
    path = f"/root/testdata/{sf}"
    assert difference(QUERIES[name](spark, path), duck(path), ORACLES[name]) is None
