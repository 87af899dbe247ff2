"""The registered queries with SQL, on the smallest data set."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from cohortry.llm.queries import llm_oracle, llm_queries
from tests.compare import connect, difference

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(BASE).exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    return connect(BASE)


@pytest.mark.parametrize("name", sorted(llm_oracle()))
def test_query_matches_sql(spark, con, name):
    assert difference(llm_queries()[name](spark, BASE), con, llm_oracle()[name]) is None


def test_every_operator_is_registered():
    names = contract.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(llm_oracle()) < set(llm_queries())
