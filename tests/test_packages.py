"""Evidence packages: content, isolation, checksums, contexts and payloads."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import golden
from ticketlens import fixed_values as fixed
from ticketlens.operators import evidence as ev
from ticketlens.operators import metrics as me
from ticketlens.plans import audit, grounded
from ticketlens.sources import schemas
from ticketlens.sources.dimensions import factor_table
from ticketlens.workloads import queries as registered


@pytest.fixture(scope="module")
def per_company(spark):
    both = golden(spark, "one").unionByName(golden(spark, "two"))
    companies = spark.createDataFrame([("one", "One Ltd"), ("two", "Two Ltd")], "id string, name string")
    plan = audit.support_audit(me.ticket_cube(both), companies, factor_table(spark))
    return audit.audit_evidence(plan)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(
        [(1, "one", "- **Systems used:** Inbox"), (2, "two", "like one does")],
        "batch_id bigint, company_id string, text string",
    )


def test_package_content(per_company, documents):
    rows = ev.evidence_packages(per_company, documents, ["batch_id"]).orderBy("batch_id").collect()
    package = json.loads(rows[0].package)
    assert list(package) == ["company", "audit_summary", "categories", "scoring_methodology", "process_documentation"]
    assert package["audit_summary"]["total_ticket_count"] == 6
    assert [c["rank"] for c in package["categories"]] == [1, 2]
    assert package["categories"][0]["metrics"]["category"] == "account access"
    assert len(package["categories"][0]["allowed_numeric_evidence"]) == 6
    assert package["scoring_methodology"]["volume_weight"] == 0.3
    for marker in ("ticket_id", "created_at", "A test case"):
        assert marker not in rows[0].package


def test_raw_row_mentions(per_company, documents):
    packages = ev.evidence_packages(per_company, documents, ["batch_id"])
    assert {r.row_free for r in ev.raw_row_mentions(packages, ["batch_id"], ("ticket_id",)).collect()} == {True}
    leaky = packages.withColumn("package", F.concat("package", F.lit("ticket_id")))
    assert {r.markers_found for r in ev.raw_row_mentions(leaky, ["batch_id"], ("ticket_id", "none")).collect()} == {1}


@pytest.mark.parametrize("others", [0, 10_000])
def test_foreign_mentions(spark, others):
    ids = ["asia", "asia minor", "bo", "boab", "x1"]
    texts = ["asia minor here", "boab", "nothing", "bo\nboab asia", "ax1x", "asiaasia minor", ""]
    documents = spark.createDataFrame(
        [(i, ids[i % len(ids)], t) for i, t in enumerate(texts)], "batch_id int, company_id string, text string"
    )
    companies = spark.createDataFrame([(i,) for i in [*ids, *(f"company {n}" for n in range(others))]], "company_id string")
    expected = sorted(
        (i, other) for i, t in enumerate(texts) for other in ids if other != ids[i % len(ids)] and other in t
    )
    found = ev.foreign_mentions(documents, ["batch_id"], companies)
    assert sorted((r.batch_id, r.foreign_id) for r in found.collect()) == expected


def test_needles_that_share_their_first_letters(spark):
    """Ten thousand needles with the same first 20 letters: each is looked up by a run of its own."""
    needles = [f"this ticket says that {n:05d} is broken" for n in range(10_000)]
    # All texts hold the shared letters, a few a needle.
    texts = [f"this ticket says that nothing {i}" for i in range(300)] + [f"so: {needles[i * 7]}!" for i in range(200)]
    documents = spark.createDataFrame(list(enumerate(texts)), "batch_id int, text string")
    descriptions = spark.createDataFrame([(n,) for n in needles], "description string")
    index = ev.rarest_grams(descriptions.withColumnRenamed("description", "needle"), documents, ["batch_id"], "text")
    shared = index.groupBy("_gram").count().agg(F.max("count")).first()[0]
    assert index.count() == 10_000 and shared <= 300  # five digits in runs of four: ten needles or more a run
    found = ev.quoted_tickets(documents, ["batch_id"], descriptions)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
    got = {(r.batch_id, r.description) for r in found.collect()}
    assert got == {(300 + i, needles[i * 7]) for i in range(200)}


@pytest.mark.parametrize("sampled", [1, 1_000_000])
def test_sampled_counts_change_no_result(spark, monkeypatch, sampled):
    monkeypatch.setattr(ev, "SAMPLED", sampled)
    needles = ["a", "ab", "abc", "abcd", "abcde", "xabcd", "😀é😀é", "é", "bcdbcd", "line\nbreak", "[^.]*"]
    texts = ["abcd", "xabcde", "", None, "zz 😀é😀é zz", "bcdbcdbcd", "a line\nbreak", "a[^.]*b", "e\u0301", "ab"]
    documents = spark.createDataFrame(list(enumerate(texts)), "batch_id int, text string")
    found = ev.mentions(documents, ["batch_id"], "text", spark.createDataFrame([(n,) for n in needles], "n string"))
    want = sorted((i, n) for i, t in enumerate(texts) for n in needles if t and n in t)
    assert sorted((r.batch_id, r.needle) for r in found.collect()) == want
    assert ev.mentions(documents, ["batch_id"], "text", spark.createDataFrame([(None,), ("",)], "n string")).collect() == []


def test_quoted_tickets(spark):
    documents = spark.createDataFrame([(1, "He wrote: where is it?"), (2, "none"), (3, "it")], "batch_id int, text string")
    descriptions = spark.createDataFrame([("where is it?",), ("it",), ("",), (None,)], "description string")
    found = ev.quoted_tickets(documents, ["batch_id"], descriptions).collect()
    assert sorted(map(tuple, found)) == [(1, "it"), (1, "where is it?"), (3, "it")]


def test_changed_evidence(per_company, documents):
    before = ev.evidence_packages(per_company, documents, ["batch_id"])
    edited = documents.withColumn("text", F.when(F.col("batch_id") == 2, "new").otherwise(F.col("text")))
    after = ev.evidence_packages(per_company, edited, ["batch_id"])
    assert ev.changed_evidence(before, before, ["batch_id"]).count() == 0
    assert [r.batch_id for r in ev.changed_evidence(before, after, ["batch_id"]).collect()] == [2]


def typed(spark, schema, *rows, extra="batch_id bigint"):
    full = spark.createDataFrame([], extra).schema
    for field in schema.fields:
        full = full.add(field)
    return spark.createDataFrame(list(rows), full)


def test_reports_before_and_after_refinement(spark):
    def verified(*rows):
        cells = ("T", "w", "p", ["e"], ["b"], ["a"], ["r"], ["h"], "low")
        full = typed(
            spark, schemas.RECOMMENDATION, *((b, p, c, *cells) for b, p, c, _, _ in rows), extra="batch_id bigint, pos int"
        )
        marks = spark.createDataFrame([(b, p, v, i) for b, p, _, v, i in rows], "batch_id bigint, pos int, verdict string, issue string")
        return full.join(marks, ["batch_id", "pos"])

    narratives = spark.createDataFrame(
        [(b, "first", ["l1"], "second", ["l2"]) for b in (1, 2, 3)]
        + [(4, "first", ["l1"], None, None), (5, "", ["l1"], "second", ["l2"]), (6, "first", ["l1"], "second", None)],
        "batch_id bigint, initial_summary string, initial_limitations array<string>, "
        "refined_summary string, refined_limitations array<string>",
    )
    before = verified(*((b, 0, "a", "accepted", None) for b in range(1, 7)), (1, 1, "b", "unsupported", "issue before"))
    after = verified(
        (1, 0, "b", "accepted", None),
        (1, 1, "c", "unsupported", "issue after"),
        (2, 0, "c", "unsupported", "no draft left"),
        (3, 0, "b", "accepted", None),
        (6, 0, "b", "accepted", None),
    )
    rejected = spark.createDataFrame([(3,)], "batch_id bigint")
    initial = grounded.initial_reports(before.filter("verdict = 'accepted'").drop("verdict", "issue"), narratives)
    refined = grounded.refined_reports(after, narratives, rejected)
    rows = {r.batch_id: r for r in grounded.active_reports(initial, refined).collect()}
    figures = {b: (r.refined, r.executive_summary, r.report_limitations, [x.category for x in r.recommendations]) for b, r in rows.items()}
    assert figures == {
        1: (True, "second", ["l2", "issue after"], ["b"]),  # issues join the limitations only here
        2: (False, "first", ["l1"], ["a"]),  # no refined draft stands
        3: (False, "first", ["l1"], ["a"]),  # answers contradict the audit
        4: (False, "first", ["l1"], ["a"]),
        6: (True, "second", [], ["b"]),
    }


def test_contexts_and_payloads(spark, per_company, documents):
    analyses = typed(
        spark, schemas.PROCESS_ANALYSIS,
        (1, 0, "account access", ["look"], ["Inbox"], [], True, []), (2, 0, "account access", [], [], [], True, []),
        extra="batch_id bigint, pos int",
    )
    covered = spark.createDataFrame([(1, True), (2, False)], "batch_id bigint, ok boolean")
    report = typed(
        spark, schemas.RECOMMENDATION,
        *((b, 1, "account access", "T", "w", "p", ["e"], ["b"], ["a"], ["r"], ["h"], "low") for b in (1, 2)),
        extra="batch_id bigint, pos int",
    )
    reports = grounded.recommendation_lists(report).withColumns(
        {"executive_summary": F.lit("sum"), "report_limitations": F.array(F.lit("limit"))}
    )
    answers = spark.createDataFrame(
        [(1, 1, "q", "Who?", "A lead", "label"), (1, 0, "z", "When?", "Soon", "label")],
        "batch_id bigint, pos int, question_id string, question string, answer string, source_label string",
    )
    history = spark.createDataFrame(
        [(1, [("user", "hello")])], "batch_id bigint, recent_turns array<struct<role:string,content:string>>"
    )
    contexts = grounded.contexts(
        spark.createDataFrame([(1,)], "batch_id bigint"),
        documents,
        grounded.analysis_lists(analyses, covered),
        reports,
        grounded.answer_lists(answers),
        history,
        per_company,
    )
    one = contexts.collect()
    assert [r.batch_id for r in one] == [1]  # the other result isn't complete
    one = one[0]
    assert [a.answer for a in one.clarification_answers] == ["Soon", "A lead"]  # as submitted
    assert one.evidence_catalog[-1] == "Process documentation — **Systems used:** Inbox"
    assert "Verified recommendation — account access — risk: r" in one.evidence_catalog
    assert "Process documentation — account access — system: Inbox" in one.evidence_catalog
    assert len(set(one.evidence_catalog)) == len(one.evidence_catalog)

    questions = spark.createDataFrame([(1, 1, " Why? "), (1, 2, " \n"), (1, 3, "How?")], "batch_id bigint, turn bigint, question string")
    asked = grounded.asked(contexts, questions)
    rows = grounded.with_payload(grounded.stage_rows(asked, "chat"), "chat").collect()
    assert {r.turn: r.payload.split("[user_question]\n")[1] for r in rows} == {1: "Why?", 3: "How?"}
    told = grounded.rules()
    assert all(told in r.payload for r in rows)
    assert all(label in told for label in fixed.ASSUMPTION_LABELS) and fixed.FORBIDDEN_CLAIM in told
    drafts = grounded.with_payload(grounded.stage_rows(contexts, "executive report"), "executive report", "own rules").head()
    assert "own rules" in drafts.payload and "Ticket count" not in drafts.payload and drafts.turn is None
    assert "A test case" not in rows[0].payload


def test_outputs_repeat(spark, sf_dir):
    """Two runs of the same job give the same rows."""
    for name in ("opportunity_ranking", "chat_context"):
        runs = [sorted(map(str, registered.QUERIES[name](spark, sf_dir).collect())) for _ in range(2)]
        assert runs[0] == runs[1]
