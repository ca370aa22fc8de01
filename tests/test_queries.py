"""Every registered query that has SQL gives the SQL's rows on the smallest tables."""

import pytest

from conformix.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
#: Plans that take long at any size; the driver's own comparison runs them.
SLOW = {"a02_rule_counts", "a04_coverage", "r15_all_within", "n07_block_warnings"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - SLOW))
def test_query_matches_sql(spark, con, name):
    compare(spark, con, SF, registry.QUERIES[name], registry.ORACLES[name])


def test_every_query_has_sql_or_is_the_bench():
    assert set(registry.QUERIES) - set(registry.ORACLES) <= {"bench_seven_rules"}
