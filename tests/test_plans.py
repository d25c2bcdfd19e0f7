"""No registered query may pair all rows of two sides."""

import pytest

from recordloom.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("first", range(4))
def test_no_cross_joins(spark, first):
    found = []
    for name in sorted(QUERIES)[first::4]:
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
            found.append(name)
    assert found == []
