"""The registered queries that have SQL, on the smallest tables."""

import os

import pytest

from lumenfold.llm import registry
from tests import oracle

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_as_sql(spark, name):
    assert oracle.differences(registry.queries()[name](spark, SF), oracle.connect(SF), registry.oracle_sql()[name]) == []
