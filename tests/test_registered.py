"""Registered queries against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from oracle_check import compare, connect
from ticketlens.workloads.oracle import ORACLES
from ticketlens.workloads.queries import QUERIES



@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def con_larger():
    return connect("/root/testdata/sf0.01")


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, sf_dir, name):
    """The same rows; and no plan pairs all rows with all, or leaves the JVM."""
    frame = QUERIES[name](spark, sf_dir)
    text = frame._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython"):
        assert node not in text
    assert compare(spark, con, sf_dir, name, frame) is None


# Joins that are broadcast on small tables must give the same as shuffle joins.
@pytest.mark.parametrize(
    "name",
    ["opportunity_ranking", "verify_recommendations", "verify_chat_answers", "evidence_isolation", "result_complete"],
)
def test_query_equals_oracle_without_broadcasts(spark, con, sf_dir, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert compare(spark, con, sf_dir, name) is None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


VERDICTS = ("verdict", "ok", "status", "row_free", "unchanged", "refined", "is_empty", "broken", "required", "process_analysis",
            "evidence", "report", "clarification_questions", "has_factors")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_every_verdict_occurs(con_larger, name):
    """Each boolean or verdict column takes two values or more."""
    rows = con_larger.execute(ORACLES[name])
    columns = [d[0] for d in rows.description]
    # turn_contract lists broken turns only, and the given turns break one bound.
    if set(VERDICTS) & set(columns) and name != "turn_contract":
        found = rows.fetchall()
        for column in set(VERDICTS) & set(columns):
            assert len({r[columns.index(column)] for r in found}) > 1, column


def test_every_check_finds_something(con_larger):
    found = con_larger.execute(f'SELECT "check" FROM ({ORACLES["dq_report"]}) WHERE findings > 0').fetchall()
    assert len({r[0] for r in found}) == 6


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.columns == ["company_id", "category", "ticket_count", "automation_score", "rank"]
    assert frame.count() == 25
