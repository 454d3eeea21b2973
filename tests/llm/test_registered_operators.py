"""Operators that SQL can express, against DuckDB on the smallest tables."""

import pytest
from oracle_check import compare, connect

from ticketlens.llm.oracle import ORACLES
from ticketlens.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_operator_equals_oracle(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    text = frame._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow", "Pandas"):
        assert node not in text
    assert compare(spark, connect(sf_dir), sf_dir, name, frame) is None
