"""The maintained audit, pruning by the registry, and score functions of SQL."""

import pytest
from pyspark.sql import functions as F

from helpers import golden, tickets
from ticketlens.functions import sql
from ticketlens.operators import metrics as me
from ticketlens.operators import scoring as sc
from ticketlens.plans import maintained
from ticketlens.sources import tickets as ti
from ticketlens.sources.dimensions import factor_table


def _cells(frame):
    return sorted(map(repr, frame.select(sorted(frame.columns)).collect()))


@pytest.fixture
def folders(tmp_path):
    return str(tmp_path / "tickets"), str(tmp_path / "state")


def _recorded(spark, folder, seen):
    read = maintained.stored_tickets(spark, folder)

    def recorded(paths):
        seen.append(set(paths))
        frame = read(paths)
        assert set(frame.inputFiles()) == {p.replace("file:", "file://", 1).replace(" ", "%20") for p in paths}
        return frame

    return recorded


def test_new_files_alone_are_read_and_the_audit_is_the_whole_one(spark, folders):
    folder, state = folders
    seen = []
    parts = [golden(spark, "one"), golden(spark, "middle east"), tickets(spark, [("one", "z", "fraud review", 0.1, True, "chat", "gold")] * 3)]
    for i, part in enumerate(parts):
        part.write.mode("append").partitionBy("company_id").parquet(folder)
        assert maintained.refresh(spark, state, folder, _recorded(spark, folder, seen)) > 0
        whole = spark.read.parquet(folder)
        merged = maintained.cube(spark, state, folder)
        assert _cells(merged) == _cells(me.ticket_cube(whole))
        assert _cells(me.support_summary(merged)) == _cells(me.support_summary(me.ticket_cube(whole)))
        assert len(seen) == i + 1
    assert not (seen[0] & seen[1] or seen[1] & seen[2] or seen[0] & seen[2])
    assert maintained.refresh(spark, state, folder, _recorded(spark, folder, seen)) == 0 and len(seen) == 3
    plan = maintained.cube(spark, state, folder)._jdf.queryExecution().executedPlan().toString()
    assert f"{folder}/company_id" not in plan and "resolution_minutes" not in plan


def test_changed_and_lost_files_and_half_written_loads(spark, folders):
    folder, state = folders
    golden(spark).write.parquet(f"{folder}/a")
    golden(spark).write.parquet(f"{folder}/b")
    flat = lambda paths: spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("file"))
    maintained.refresh(spark, state, folder, flat)
    # A load whose files were never written down does not count.
    maintained.file_cubes(flat([f"{folder}/a"])).write.parquet(f"{state}/cubes/load=half")
    total = lambda: me.overall_metrics(maintained.cube(spark, state, folder)).first()["total_ticket_count"]
    assert total() == 12
    golden(spark).limit(2).coalesce(1).write.mode("overwrite").parquet(f"{folder}/a")
    assert total() == 6  # what was read is gone, what is there now is not read yet
    assert maintained.refresh(spark, state, folder, flat) >= 1
    assert total() == 8


def test_an_empty_state(spark, folders):
    folder, state = folders
    golden(spark).limit(0).coalesce(1).write.parquet(folder)
    count = maintained.refresh(spark, state, folder, maintained.stored_tickets(spark, folder))
    assert count == len(maintained.listing(spark, folder).collect())
    if count:
        assert maintained.cube(spark, state, folder).count() == 0


def test_the_registry_prunes_files_at_run_time(spark, folders):
    folder, _ = folders
    for name in ("one", "two", "three"):
        golden(spark, name).write.mode("append").partitionBy("company_id").parquet(folder)
    registry = spark.createDataFrame([("one", "shop"), ("two", "bank"), ("two", "bank")], "company_id string, industry string")
    registry.write.parquet(f"{folder}-registry")
    asked = spark.read.parquet(f"{folder}-registry").filter("industry = 'bank'")
    frame = me.overall_metrics(me.ticket_cube(ti.tickets_of(spark, folder, asked), ()))
    assert "dynamicpruning" in frame._jdf.queryExecution().executedPlan().toString().lower()
    assert [(r["company_id"], r["total_ticket_count"]) for r in frame.collect()] == [("two", 6)]


def test_functions_of_sql_equal_the_columns(spark):
    sql.register(spark)
    rows = [
        (count, most, minutes, rate, *factors)
        for count, most in ((1, 4), (3, 4), (4, 4), (0, 0), (None, 4))
        for minutes in (-1.0, 0.0, 29.99, 30.0, 500.0, None)
        for rate in (0.0, 0.05, 0.2, 0.21, 1.5)
        for factors in ((1.0, 1.0), (0.5, 0.4), (0.1, 0.65))
    ]
    frame = spark.createDataFrame(rows, sql.ARGUMENTS.replace(" BIGINT", " bigint").replace(" DOUBLE", " double"))
    names = ", ".join(frame.columns)
    both = frame.select(
        sc.automation_score().alias("a"), F.expr(f"automation_score({names})").alias("b"),
        sc.explanation().alias("c"), F.expr(f"automation_explanation({names})").alias("d"),
    )
    assert both.filter("NOT (a <=> b AND c <=> d)").collect() == []
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "automation_score(" not in plan and "Python" not in plan


def test_functions_of_sql_over_a_view(spark):
    sql.register(spark)
    sc.with_factors(me.category_metrics(me.ticket_cube(golden(spark), ["category"])), factor_table(spark)).createOrReplaceTempView("counted")
    names = ", ".join(a.split(" ")[0] for a in sql.ARGUMENTS.split(", "))
    found = spark.sql(f"SELECT category, automation_score({names}) AS score FROM counted WHERE automation_score({names}) > 0")
    want = sc.scored(me.category_metrics(me.ticket_cube(golden(spark), ["category"])), factor_table(spark))
    assert {r["category"]: r["score"] for r in found.collect()} == {r["category"]: r["automation_score"] for r in want.collect()}
