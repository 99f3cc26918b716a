"""Every query of the engine's own operators against its SQL; queries without SQL must give rows."""

import pytest
from oracle import same, views

from loomrank.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLES:
        assert same(df, duck.execute(catalog.ORACLES[name])) > 0
    else:
        assert df.count() > 0
