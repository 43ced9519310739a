"""Every registered query of the engine against its oracle."""

import pytest

from factloom.plans import registry
from tests.oracle import compare, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_oracle(spark, con, name):
    _, ours, theirs = compare(spark, con, SF, registry.queries()[name], registry.oracle_sql()[name])
    assert not ours and not theirs


@pytest.mark.parametrize("name", ["lateral_tokens", "sorted_locations", "package_agreement", "references", "rule_unresolved_function"])
def test_against_oracle_on_larger_tables(spark, name):
    sf = SF.replace("0.001", "0.01")
    n, ours, theirs = compare(spark, views(sf), sf, registry.queries()[name], registry.oracle_sql()[name])
    assert n and not ours and not theirs
