"""Every query of the registry against its SQL."""

import pytest

from tagloom.plans import registry
from tests import oracle

#: Queries that rightly give nothing on the smallest table: no two signatures are so near.
EMPTY = {"hamming_pairs_banded"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, sf_dir, con, name):
    n = oracle.same(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLE[name])
    assert n or name in EMPTY


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count()
