"""Every registered relational query against its SQL twin on the smallest tables."""

import os

import pytest

from lakeloom import registry
from tests.oracle import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
registry.load()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, name, registry.QUERIES[name], registry.SQL[name], SF_DIR) == ""


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_names_are_registered_once():
    with pytest.raises(ValueError, match="twice"):
        registry.query("p04_pricing_summary")(lambda s, d: None)


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
