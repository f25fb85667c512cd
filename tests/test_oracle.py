"""Every query of the engine that has SQL gives the rows of that SQL."""

import pytest

from lodestar.plans import catalogue, statements  # noqa: F401  statements registers its queries
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    if name in catalogue.SQL:
        same(df, con, catalogue.SQL[name])
    else:
        assert df.count() >= 0
