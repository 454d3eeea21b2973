"""Plans that must hold at scale: shuffles, pruning, pushed limits, no pair joins."""

import pytest
from pyspark.sql import functions as F

from helpers import golden
from ticketlens.operators import chat as ch
from ticketlens.operators import metrics as me
from ticketlens.operators import quality as qu
from ticketlens.operators import questions as qs
from ticketlens.operators import recommendations as rc
from ticketlens.plans import audit, grounded
from ticketlens.sources.dimensions import factor_table
from ticketlens.workloads import queries as registered
from ticketlens.workloads import tables as tb


def plan(frame) -> str:
    """The executed plan; adaptive plans print their initial form."""
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(frame) -> int:
    return sum(line.lstrip("+- :*()0123456789").startswith("Exchange ") for line in plan(frame).splitlines())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "tickets")
    golden(spark).write.partitionBy("company_id").parquet(path)
    return spark.read.parquet(path)


def test_overall_reads_two_columns(stored):
    text = plan(me.overall_metrics(me.ticket_cube(stored, ())))
    assert "ReadSchema: struct<resolution_minutes:double,escalated:boolean>" in text


def test_a_company_filter_prunes_partitions(stored):
    frame = me.overall_metrics(me.ticket_cube(stored, ())).filter("company_id = 'one'")
    assert "PartitionFilters: [isnotnull(company_id" in plan(frame)


def test_metrics_shuffle_tickets_once_after_partial_sums(spark, stored):
    frame = audit.opportunities(me.ticket_cube(stored, ["category"]), factor_table(spark))
    text = plan(frame)
    # One exchange on (company, category) and one on company for all windows.
    assert exchanges(frame) == 2
    assert "partial_sum" in text and "ObjectHashAggregate" not in text
    assert "SortAggregate" not in text


def test_summary_expands_the_cube_not_the_tickets(stored):
    lines = plan(me.support_summary(me.ticket_cube(stored))).splitlines()
    expand = next(i for i, line in enumerate(lines) if "Expand" in line)
    exchange = max(i for i, line in enumerate(lines) if "Exchange " in line)
    assert expand < exchange  # the tickets' exchange lies below the expansion


def test_duplicates_read_and_shuffle_the_key_only(spark, stored):
    frame = qu.duplicate_keys(stored)
    assert exchanges(frame) == 1 and "partial_count" in plan(frame)
    assert "ReadSchema: struct<ticket_id:string>" in plan(frame)


def test_history_limit_is_pushed_below_the_exchange(spark, sf_dir):
    text = plan(ch.bounded_history(tb.chat_turns(spark, sf_dir)))
    assert text.index("WindowGroupLimit") < text.index("Exchange ") < text.rindex("WindowGroupLimit")


def test_batches_move_once_for_verdicts_and_gate(spark, sf_dir):
    drafts = tb.recommendation_drafts(spark, sf_dir, _evidence(spark))
    gate = rc.batch_gate(rc.verify_recommendations(drafts, _evidence(spark)))
    assert plan(gate).count("Exchange hashpartitioning(batch_id") == 1


def test_draft_texts_are_not_shuffled_for_verdicts(spark, tmp_path):
    schema = ", ".join(
        ["batch_id bigint, pos int, company_id string, category string, title string"]
        + [f"{c} string" for c in ("current_workflow", "proposed_automation")]
        + [f"{c} array<string>" for c in ("evidence", "expected_benefits", "assumptions", "risks", "human_review_points")]
    )
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "drafts"))
    drafts = spark.read.schema(schema).parquet(str(tmp_path / "drafts"))
    verified = rc.verify_recommendations(drafts, _evidence(spark)).select("batch_id", "pos", "verdict")
    lines = plan(verified).splitlines()
    join = next(i for i, line in enumerate(lines) if "Join " in line)
    assert "current_workflow" not in lines[join - 1]
    assert "current_workflow" in "".join(lines[join:])


@pytest.fixture
def by_batch(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tb, "PER_BUCKET", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    yield tb.by_batch(spark, sf_dir)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_documents_by_batch_are_the_documents(spark, sf_dir, by_batch):
    plain, laid = tb.table(spark, sf_dir, "documents"), tb.table(spark, by_batch, "documents")
    assert by_batch.parts == 4 and laid.schema == plain.schema
    assert sorted(laid.collect()) == sorted(plain.collect())
    assert not any("documents_by_batch" in t.name for t in spark.catalog.listTables())


def test_what_documents_by_batch_give_is_not_moved_again(spark, by_batch):
    # As small as staged evidence of companies is.
    evidence = F.broadcast(_evidence(spark))
    categories = F.broadcast(qs.company_categories(_evidence(spark)))
    accepted = rc.accepted(rc.verify_recommendations(tb.recommendation_drafts(spark, by_batch, evidence), evidence))
    questions = qs.verify_questions(tb.question_drafts(spark, by_batch), categories).filter("verdict = 'accepted'")
    answers = qs.verify_answers(tb.clarification_answers(spark, by_batch), questions)
    for frame in (accepted, grounded.recommendation_lists(accepted), questions, answers):
        assert "Exchange hashpartitioning(batch_id" not in plan(frame)


def test_contexts_move_no_text(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tb, "PER_BUCKET", 50)
    results = registered._Results(spark, sf_dir).ready()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30k")
    try:
        lines = plan(results.contexts()).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in lines if "Exchange hashpartitioning(batch_id" in line or "Exchange hashpartitioning(doc_id" in line]
    # The ids of complete batches and the histories, which come from conversations.
    assert len(moved) <= 2


def test_duplicates_are_told_by_category_within_a_batch(spark):
    """Null ids are equal to each other, as in a grouping."""
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, None), (2, 1, None), (2, 2, "a")]
    drafts = spark.createDataFrame(
        [(b, p, "asia", q, "Who approves this?", ["view"]) for b, p, q in rows],
        "batch_id bigint, pos int, company_id string, question_id string, question string, related_categories array<string>",
    )
    found = qs.verify_questions(drafts, qs.company_categories(_evidence(spark))).orderBy("batch_id", "pos")
    assert [r.verdict for r in found.collect()] == ["accepted", "accepted", "duplicate", "accepted", "duplicate", "accepted"]


def _evidence(spark):
    return spark.createDataFrame(
        [("asia", "view", ["Ticket count: 1", "Automation score: 1.00/100"])],
        "company_id string, category string, allowed_numeric_evidence array<string>",
    )


@pytest.mark.parametrize(
    ("name", "table", "most"),
    [("chat_context", "documents", 4), ("clarification_answers", "documents", 2), ("dq_report", "events", 1)],
)
def test_a_table_is_read_few_times(spark, sf_dir, name, table, most):
    text = plan(registered.QUERIES[name](spark, sf_dir))
    assert text.count(f"{table}.parquet") <= most


def test_cells_are_parsed_once(spark, sf_dir):
    """A filter on violations stands above the parse, not beside a copy of it."""
    lines = plan(registered.QUERIES["normalized_tickets"](spark, sf_dir)).splitlines()
    assert not any("Filter" in line and "rlike" in line.lower() for line in lines)


def test_texts_are_joined_before_company_evidence(spark, sf_dir):
    lines = plan(registered.QUERIES["chat_context"](spark, sf_dir)).splitlines()
    joins = [line for line in lines if "Join " in line]
    assert "company_id" in joins[0] and all("company_id" not in line.split("],")[0] for line in joins[1:2])


def test_a_company_with_most_rows(spark):
    """Nine tenths of the rows in one company and category."""
    hot = spark.range(90_000).select(F.lit("hot").alias("company_id"), "id")
    cold = spark.range(10_000).select(
        F.concat(F.lit("c"), (F.col("id") % 500).cast("string")).alias("company_id"), "id"
    )
    frame = hot.unionByName(cold).select(
        "company_id",
        F.col("id").cast("string").alias("ticket_id"),
        F.lit("order status").alias("category"),
        F.lit(0.1).alias("resolution_minutes"),
        (F.col("id") % 2 == 0).alias("escalated"),
        F.lit("email").alias("channel"),
        F.lit("vip").alias("customer_tier"),
    )
    rows = {r.company_id: r for r in me.overall_metrics(me.ticket_cube(frame)).collect()}
    assert len(rows) == 501
    assert rows["hot"].total_ticket_count == 90_000 and rows["hot"].total_handling_hours == 150.0
    assert rows["hot"].overall_escalation_rate == 0.5
