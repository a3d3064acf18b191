"""Every registered query against its SQL; those without SQL have to run and give rows."""

import os

import pytest
from oracle import connect, same

from tessera import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    same(registry.queries()[name](spark, FOLDER), con, SQL[name])


#: Iterative queries of many small jobs; tests/test_graph.py has their operators on small graphs.
SLOW = set() if os.environ.get("TEST_SLOW") else {"G02_louvain", "G03_leiden", "G05_label_propagation", "G07_multi_resolution"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL) - SLOW))
def test_rows(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


def test_names_and_imports():
    assert registry.FLAGSHIP in registry.queries()
    assert not any(n.startswith("op") for n in registry.queries())
