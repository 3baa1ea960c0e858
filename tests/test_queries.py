"""Each registered query against its SQL."""

import pytest

from siltbed.plans.oracles import ORACLES
from siltbed.plans.queries import QUERIES

from .conftest import rows_of


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    mine = QUERIES[name](spark, sf_dir).toPandas()
    assert len(mine)
    if name in ORACLES:
        other = duck.sql(ORACLES[name]).df()
        assert sorted(mine.columns) == sorted(other.columns)
        assert rows_of(mine) == rows_of(other)
