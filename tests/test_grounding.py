"""Verdict jobs against loops over plain Python lists."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ticketlens import fixed_values as fixed
from ticketlens.errors import GroundingError
from ticketlens.operators import catalog as ca
from ticketlens.operators import chat as ch
from ticketlens.operators import drafts as dr
from ticketlens.operators import questions as qs
from ticketlens.operators import recommendations as rc
from ticketlens.operators import report as rp
from ticketlens.sources import schemas

LINES = {"order status": ["Ticket count: 2", "Automation score: 87.50/100"], "returns": ["Ticket count: 9", "x", "y"]}
DRAFT = (
    "batch_id bigint, pos int, company_id string, category string, title string, current_workflow string, "
    "proposed_automation string, evidence array<string>, expected_benefits array<string>, "
    "assumptions array<string>, risks array<string>, human_review_points array<string>, confidence string"
)


def draft(batch, pos, category="order status", evidence=None, **changes):
    cells = {
        "title": "Assist agents",
        "current_workflow": "Look it up",
        "proposed_automation": "Draft a reply",
        "evidence": LINES.get(category, ["a", "b"])[:2] if evidence is None else evidence,
        "expected_benefits": ["Faster"],
        "assumptions": ["Tools stay"],
        "risks": ["Wrong reply"],
        "human_review_points": ["Agent checks"],
        "confidence": "low",
        **changes,
    }
    return (batch, pos, "one", category, *cells.values())


@pytest.fixture(scope="module")
def evidence(spark):
    return spark.createDataFrame(
        [("one", c, lines) for c, lines in LINES.items()],
        "company_id string, category string, allowed_numeric_evidence array<string>",
    )


def judged(spark, evidence, rows):
    out = rc.verify_recommendations(spark.createDataFrame(rows, DRAFT), evidence)
    return {(r.batch_id, r.pos): (r.verdict, r.issue) for r in out.collect()}


def loop_over_drafts(rows):
    result, accepted = {}, {}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        batch, pos, _, category, title, flow, proposal, evidence, benefits, assumptions, risks, reviews, _ = row
        if pos >= 3:
            continue
        texts = [title, flow, proposal, *benefits, *assumptions, *risks, *reviews]
        seen = accepted.setdefault(batch, set())
        if category not in LINES:
            verdict = "unsupported"
        elif category in seen:
            verdict = "duplicate"
        elif len(evidence) < 2 or not set(evidence) <= set(LINES[category]):
            verdict = "evidence"
        elif re.search(r"\d", " ".join(texts)):
            verdict = "numeric"
        elif "guarantee" in " ".join(texts).lower():
            verdict = "guarantee"
        else:
            verdict = "accepted"
            seen.add(category)
        result[batch, pos] = verdict
    return result


def test_recommendation_branches(spark, evidence):
    rows = [
        draft(1, 0, "lost badge"),
        draft(1, 1, evidence=["Ticket count: 3", "Automation score: 87.50/100"]),
        draft(1, 2),
        draft(2, 0, evidence=["Ticket count: 2"]),
        draft(2, 1, evidence=["Ticket count: 2", "Ticket count: 2"]),
        draft(2, 2),
        draft(2, 3, "returns"),
        draft(3, 0, risks=["Fails 3 times"]),
        draft(3, 1, human_review_points=["٤ checks"]),
        draft(3, 2, expected_benefits=["GUARANTEED"]),
    ]
    got = judged(spark, evidence, rows)
    assert {k: v for k, (v, _) in got.items()} == loop_over_drafts(rows)
    assert got[1, 0] == ("unsupported", "Rejected unsupported category: lost badge")
    assert got[1, 1][1].startswith("Rejected order status: numeric evidence was missing")
    assert got[1, 2] == ("accepted", None)  # an earlier rejected one does not block it
    assert got[2, 1][0] == "accepted"  # repeated lines count
    assert got[2, 2] == ("duplicate", "Rejected duplicate category recommendation: order status")
    assert (2, 3) not in got
    assert got[3, 1][0] == "numeric" and got[3, 2][0] == "guarantee"


def random_drafts(batches, seed):
    rng = random.Random(seed)
    rows = []
    for batch in range(batches):
        for pos in range(rng.randint(1, 5)):
            category = rng.choice([*LINES, "lost badge"])
            pool = [*LINES.get(category, []), "Invented"]
            weights = [9] * (len(pool) - 1) + [1]
            lines = rng.choices(pool, weights, k=rng.choice([1, 2, 2, 3]))
            words = rng.choice(["fine"] * 6 + ["now 5 times", "a Guarantee"])
            rows.append(draft(batch, pos, category, lines, current_workflow=words))
    return rows


def test_recommendations_equal_the_loop(spark, evidence):
    rows = random_drafts(600, 5)
    got = {k: v for k, (v, _) in judged(spark, evidence, rows).items()}
    assert got == loop_over_drafts(rows)
    assert set(got.values()) == {"accepted", "unsupported", "duplicate", "evidence", "numeric", "guarantee"}


def test_gate_and_issue_merge(spark, evidence):
    rows = [draft(1, 0, "lost badge"), draft(1, 1), draft(2, 0, "x"), draft(2, 1, "y"), draft(3, 0)]
    verified = rc.verify_recommendations(spark.createDataFrame(rows, DRAFT), evidence)
    gate = {r.batch_id: r.ok for r in rc.batch_gate(verified).collect()}
    assert gate == {1: True, 2: False, 3: True}
    with pytest.raises(GroundingError):
        rc.require_accepted(rc.batch_gate(verified))
    narratives = spark.createDataFrame([(1, ["own"]), (2, None), (3, ["only"])], "batch_id bigint, limitations array<string>")
    merged = {r.batch_id: r.limitations for r in rp.merged_limitations(narratives, verified).collect()}
    assert merged == {
        1: ["own", "Rejected unsupported category: lost badge"],
        2: ["Rejected unsupported category: x", "Rejected unsupported category: y"],
        3: ["only"],
    }


QUESTION = "batch_id bigint, pos int, company_id string, question_id string, question string, related_categories array<string>"


def loop_over_questions(rows):
    result, accepted = {}, {}
    checks = (
        ("known metric", fixed.KNOWN_METRIC_REQUESTS),
        ("vague", fixed.VAGUE_QUESTIONS),
        ("documented", fixed.DOCUMENTED_REQUESTS),
    )
    for batch, pos, _, name, question, related in sorted(rows, key=lambda r: r[:2]):
        if pos >= 3:
            continue
        seen = accepted.setdefault(batch, set())
        if name in seen:
            verdict = "duplicate"
        else:
            verdict = next(
                (label for label, phrases in checks if any(p in question.lower() for p in phrases)), None
            ) or ("accepted" if set(related) <= set(LINES) else "unsupported")
        if verdict == "accepted":
            seen.add(name)
        result[batch, pos] = verdict
    return result


def test_questions_equal_the_loop(spark):
    rng = random.Random(8)
    texts = ["Who approves refunds?"] * 5 + [
        "How many tickets arrive?",
        "Please PROVIDE more information.",
        "Which systems are used?",
        "What exception cases and what escalation rate?",
    ]
    rows = [
        (b, p, "one", rng.choice(["a", "b", "c"]), rng.choice(texts), rng.choice([["returns"], ["order status", "returns"], ["other"]]))
        for b in range(500)
        for p in range(rng.randint(1, 5))
    ]
    categories = spark.createDataFrame([("one", list(LINES))], "company_id string, known_categories array<string>")
    out = qs.verify_questions(spark.createDataFrame(rows, QUESTION), categories)
    got = {(r.batch_id, r.pos): r.verdict for r in out.collect()}
    assert got == loop_over_questions(rows)
    assert set(got.values()) == {"accepted", "duplicate", "known metric", "vague", "documented", "unsupported"}
    assert out.filter("verdict = 'accepted' AND issue IS NOT NULL").count() == 0


def test_answers(spark):
    questions = spark.createDataFrame(
        [(1, "a", "Who?"), (1, "b", "Why?"), (2, "a", "Who?"), (3, "a", "Who?")],
        "batch_id bigint, question_id string, question string",
    )
    answers = spark.createDataFrame(
        [
            (1, 5, "a", "  A lead does. \n"),
            (1, 4, "b", " \t"),
            (1, 3, "zz", "Our handling hours are 7."),
            (2, 0, "a", "Our Handling Hours are 7."),
            (2, 1, "zz", "hello"),
            (3, 0, "a", "The handling hours are unknown"),
        ],
        "batch_id bigint, pos int, question_id string, answer string",
    )
    out = qs.verify_answers(answers, questions)
    rows = {(r.batch_id, r.question_id): r for r in out.collect()}
    assert {k: r.verdict for k, r in rows.items()} == {
        (1, "a"): "accepted",
        (1, "b"): "dropped",
        (1, "zz"): "dropped",  # an unknown question cannot contradict
        (2, "a"): "submission rejected",
        (2, "zz"): "submission rejected",
        (3, "a"): "accepted",
    }
    assert rows[1, "a"].answer == "A lead does."
    assert rows[1, "a"].source_label == "stakeholder-provided clarification"
    assert sorted(r.batch_id for r in qs.clarifications(out).collect()) == [1, 3]
    with pytest.raises(GroundingError, match="overwrite canonical"):
        qs.require_answers(out)


CATALOG = ["Ticket count: 1,042", "Automation score: 87.50/100", "Process documentation — **Systems used:** Inbox"]
ANSWER = (
    "batch_id bigint, turn bigint, company_id string, question string, answer string, "
    "evidence_used array<string>, assumptions array<string>, missing_information array<string>"
)


def loop_over_answers(rows):
    result = {}
    token = re.compile(r"\d[\d,]*(?:\.\d+)?%?(?:/\d+)?")
    for conv, turn, _, question, answer, cited, assumptions, missing in rows:
        joined = " ".join(cited)
        if not question.strip():
            verdict = "blank question"
        elif any(c not in CATALOG for c in cited):
            verdict = "outside"
        elif not cited and not missing:
            verdict = "neither"
        elif any(not a.startswith(fixed.ASSUMPTION_LABELS) for a in assumptions):
            verdict = "unlabelled"
        elif any(t not in joined for t in token.findall(answer)):
            verdict = "number"
        elif "guarantee" in answer.lower():
            verdict = "guarantee"
        else:
            verdict = "accepted"
        result[conv, turn] = verdict
    return result


def test_chat_answers_equal_the_loop(spark):
    rng = random.Random(12)
    rows = []
    for conv in range(700):
        rows.append(
            (
                conv,
                1,
                "one",
                rng.choice(["Why?"] * 9 + [" \n"]),
                rng.choice(["It holds.", "Of 1,042 cases", "Score 87.50/100.", "See 42", "It is 7", "We GUARANTEE it"]),
                rng.choices([*CATALOG, "Invented"], [4, 4, 4, 1], k=rng.randint(0, 3)),
                rng.choice([[], ["Model assumption: a"], ["no label"], ["Stakeholder clarification: b"]]),
                rng.choice([[], ["a gap"]]),
            )
        )
    # Every other batch has a line of its own, which its neighbours may not cite.
    contexts = spark.createDataFrame(
        [(conv, [*CATALOG, *(["Invented"] if conv < 0 else [])]) for conv in range(-700, 700)],
        "batch_id bigint, evidence_catalog array<string>",
    )
    answers = spark.createDataFrame(rows, ANSWER)
    out = ch.verify_chat_answers(answers, ch.foreign_lines(answers, contexts))
    got = {(r.batch_id, r.turn): r.verdict for r in out.collect()}
    assert got == loop_over_answers(rows)
    assert len(set(got.values())) == 7


def test_an_answer_may_cite_its_own_batch_only(spark):
    contexts = spark.createDataFrame(
        [(1, ["own line"]), (2, ["own line", "neighbour's line"])], "batch_id bigint, evidence_catalog array<string>"
    )
    texts = [(1, 1, ["own line"]), (1, 2, ["neighbour's line"]), (2, 1, ["neighbour's line"]), (3, 1, ["own line"])]
    rows = [(b, t, "one", "Why?", "So.", cited, [], []) for b, t, cited in texts]
    answers = spark.createDataFrame(rows, ANSWER)
    out = ch.verify_chat_answers(answers, ch.foreign_lines(answers, contexts)).collect()
    assert {(r.batch_id, r.turn): r.verdict for r in out} == {
        (1, 1): "accepted", (1, 2): "outside", (2, 1): "accepted", (3, 1): "outside",
    }


def test_coverage(spark):
    metrics = spark.createDataFrame(
        [("one", "a"), ("one", "b"), ("two", "a")], "company_id string, category string"
    )
    batches = {1: "ab", 2: "a", 3: "abb", 4: "ax", 5: "abx", 6: "ba"}
    rows = [(b, "one", c) for b, cs in batches.items() for c in cs]
    analyses = spark.createDataFrame(rows, "batch_id bigint, company_id string, category string")
    out = rp.process_coverage(analyses, metrics)
    assert {r.batch_id: r.ok for r in out.filter("company_id = 'one'").collect()} == {
        b: sorted(cs) == ["a", "b"] for b, cs in batches.items()
    }
    assert [(r.batch_id, r.missing, r.ok) for r in out.filter("company_id = 'two'").collect()] == [(None, 1, False)]
    with pytest.raises(GroundingError):
        rp.require_coverage(out)


def test_completeness(spark):
    def batch(*ids):
        return spark.createDataFrame([(i,) for i in ids], "batch_id bigint")

    parts = {"evidence": batch(1, 2), "report": batch(1, 1, 9)}
    rows = {r.batch_id: (r.missing_parts, r.ok) for r in rp.result_completeness(batch(1, 2, 3), parts).collect()}
    assert rows == {1: (0, True), 2: (1, False), 3: (2, False)}


def test_bounded_history(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"Question {t}") for t in range(10)] + [(2, 0, "user", "hi")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, content string")
    lists = {r.conv_id: [t.content for t in r.recent_turns] for r in ch.history_lists(ch.bounded_history(frame, 3)).collect()}
    assert lists == {1: ["Question 7", "Question 8", "Question 9"], 2: ["hi"]}
    with pytest.raises(ValueError):
        ch.bounded_history(frame, 0)
    with pytest.raises(ValueError):
        ch.bounded_history(frame, 21)


def test_history_keeps_answer_details(spark):
    details = ("so", ["line"], [], ["gap"])
    frame = spark.createDataFrame(
        [(1, 0, "user", "q", None), (1, 1, "assistant", "so", details)],
        "conv_id bigint, turn bigint, role string, content string, answer_details "
        "struct<answer:string,evidence_used:array<string>,assumptions:array<string>,missing_information:array<string>>",
    )
    turns = ch.history_lists(ch.bounded_history(frame)).head().recent_turns
    assert [t.answer_details and tuple(t.answer_details) for t in turns] == [None, details]


def test_parsing_and_bounds(spark):
    good = (
        '{"recommendations":[{"category":"c","title":"t","current_workflow":"w","proposed_automation":"p",'
        '"evidence":["e"],"expected_benefits":["b"],"assumptions":["a"],"risks":["r"],'
        '"human_review_points":["h"],"confidence":"high"}]}'
    )
    texts = {
        1: good,
        2: good[:50],
        3: '{"other": 1}',
        4: "not json",
        5: good.replace('"high"', '"certain"'),
        6: good.replace('"risks":["r"]', '"risks":[]'),
        7: good.replace('"title":"t",', ""),
        8: '{"recommendations":"none"}',
        9: good.replace('"title":"t"', '"title":["t"]'),
        10: good.replace('"risks":["r"]', '"risks":["r",4]'),
        11: good.replace('"title":"t"', '"title":null'),
    }
    frame = spark.createDataFrame(list(texts.items()), "batch_id bigint, document string")
    parsed = dr.parse_documents(frame, schemas.RECOMMENDATION_BATCH)
    status = {r.batch_id: r.status for r in parsed.collect()}
    assert status == {1: "ok", 2: "malformed", 3: "malformed", 4: "malformed", 5: "ok", 6: "ok", 7: "ok", 8: "malformed", 9: "malformed", 10: "malformed", 11: "ok"}
    with pytest.raises(GroundingError):
        dr.require_documents_ok(parsed)
    rows = dr.explode_batch(parsed, ["batch_id"], "recommendations")
    broken = {r.batch_id: r.broken for r in dr.with_broken_bounds(rows, dr.recommendation_bounds()).collect()}
    assert broken == {1: [], 5: ["confidence"], 6: ["risks"], 7: ["title"], 11: ["title"]}
    contract = dr.batch_contract(rows, dr.recommendation_bounds(), ["batch_id"])
    assert {r.batch_id: r.ok for r in contract.collect()} == {1: True, 5: False, 6: False, 7: False, 11: False}
    assert [r.batch_id for r in dr.standing_batches(rows, contract, ["batch_id"]).collect()] == [1]


def test_findings_name_the_place(spark):
    good = (
        '{"questions":[{"question_id":"a","question":"q","rationale":"r","related_categories":["c"],"required":true},'
        '{"question_id":"b","related_categories":[]}]}'
    )
    texts = {
        1: (good, []),
        2: (good[:40], [("$", "OBJECT", None)]),
        3: (None, [("$", "OBJECT", None)]),
        4: ("[1]", [("$", "OBJECT", "ARRAY")]),
        5: ("{}", [("questions", "ARRAY", None)]),
        6: ('{"questions":null}', [("questions", "ARRAY", "VOID")]),
        7: ('{"questions":{"question_id":"a"}}', [("questions", "ARRAY", "OBJECT")]),
        8: (good.replace('"b"', "7"), [("questions[1].question_id", "STRING", "BIGINT")]),
        9: (good.replace('["c"]', '["c",null,{"x":1},[]]'), [(f"questions[0].related_categories[{i}]", "STRING", k) for i, k in ((2, "OBJECT"), (3, "ARRAY"))]),
        10: (good.replace("true", '"yes"').replace("[]", '"c"'), [("questions[0].required", "BOOLEAN", "STRING"), ("questions[1].related_categories", "ARRAY", "STRING")]),
        11: ('{"questions":["a",null]}', [("questions[0]", "OBJECT", "STRING")]),
        # Of what isn't declared nothing is expected, whatever its name.
        12: (good.replace('"question":"q"', '"question":"q","more":{"question_id":5}'), []),
        13: ('{"questions":[]}', []),
    }
    frame = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "batch_id bigint, document string")
    parsed = dr.parse_documents(frame, schemas.QUESTION_BATCH)
    found = {r.batch_id: [tuple(f) for f in r.findings] for r in parsed.collect()}
    assert found == {k: want for k, (_, want) in texts.items()}
    assert {r.batch_id: r.status for r in parsed.collect()} == {k: "malformed" if want else "ok" for k, (_, want) in texts.items()}
    rows = dr.document_findings(parsed, ["batch_id"]).filter("batch_id = 9").collect()
    assert [r.path for r in rows] == ["questions[0].related_categories[2]", "questions[0].related_categories[3]"]
    first = parsed.filter("batch_id = 1").head().parsed.questions
    assert [(q.question_id, q.question, q.related_categories, q.required) for q in first] == [("a", "q", ["c"], True), ("b", None, [], None)]
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "Python" not in plan


def test_question_bounds(spark):
    rows = [("ok_1-a", "Long enough?", "Long enough", ["c"]), ("Bad Id", "short", "Long enough", [])]
    frame = spark.createDataFrame(rows, "question_id string, question string, rationale string, related_categories array<string>")
    broken = [r.broken for r in dr.with_broken_bounds(frame, dr.question_bounds()).collect()]
    assert broken == [[], ["question_id", "question", "related_categories"]]


def test_further_bounds(spark):
    narrative = spark.createDataFrame([("", ["a"]), ("x", [])], "executive_summary string, limitations array<string>")
    broken = [r.broken for r in dr.with_broken_bounds(narrative, dr.narrative_bounds()).collect()]
    assert broken == [["executive_summary"], ["limitations"]]
    answer = spark.createDataFrame([("", [], None, [])], "answer string, evidence_used array<string>, assumptions array<string>, missing_information array<string>")
    assert dr.with_broken_bounds(answer, dr.chat_answer_bounds()).head().broken == ["answer", "assumptions"]
    analysis = spark.createDataFrame([("c", [], [], [], None, [])], schemas.PROCESS_ANALYSIS)
    assert dr.with_broken_bounds(analysis, dr.analysis_bounds()).head().broken == ["human_approval_required"]


def test_four_entries_are_too_many(spark):
    rows = [(1, i, "user", "x") for i in range(4)] + [(2, 0, "system", "x")]
    frame = spark.createDataFrame(rows, "batch_id bigint, pos int, role string, content string")
    out = {r.batch_id: (r.entries, r.broken_entries, r.ok) for r in dr.batch_contract(frame, dr.turn_bounds(), ["batch_id"]).collect()}
    assert out == {1: (4, 0, False), 2: (1, 1, False)}


OTHER_KINDS = {
    "questions": (
        schemas.QUESTION_BATCH,
        '{"questions":[{"question_id":"a","question":"Who signs it off?","rationale":"It matters.","related_categories":["c"]}]}',
        ('"question_id":"a"', '"question_id":{"a":1}'),
    ),
    "analyses": (
        schemas.PROCESS_ANALYSIS_BATCH,
        '{"analyses":[{"category":"c","repetitive_steps":["s"],"systems_used":[],"exception_cases":[],'
        '"human_approval_required":true,"observations":[]}]}',
        ("true", '"often"'),
    ),
    "narrative": (schemas.NARRATIVE, '{"executive_summary":"s","limitations":["l"]}', ('["l"]', '"l"')),
    "chat answer": (
        schemas.CHAT_ANSWER,
        '{"answer":"a","evidence_used":[],"assumptions":["m"],"missing_information":[]}',
        ('["m"]', "[[]]"),
    ),
}


@pytest.mark.parametrize("kind", OTHER_KINDS)
def test_parsing_of_the_other_documents(spark, kind):
    schema, good, (part, wrong) = OTHER_KINDS[kind]
    texts = [good, good[:20], "{}", good.replace(part, wrong), None]
    frame = spark.createDataFrame(list(enumerate(texts)), "batch_id int, document string")
    status = {r.batch_id: r.status for r in dr.parse_documents(frame, schema).collect()}
    assert status == {0: "ok", 1: "malformed", 2: "malformed", 3: "malformed", 4: "malformed"}


def test_a_question_is_not_required_by_default(spark):
    schema, good, _ = OTHER_KINDS["questions"]
    texts = [good, good.replace('"question_id"', '"required":true,"question_id"')]
    frame = spark.createDataFrame(list(enumerate(texts)), "batch_id int, document string")
    rows = dr.explode_batch(dr.parse_documents(frame, schema), ["batch_id"], "questions").collect()
    assert {r.batch_id: r.required for r in rows} == {0: False, 1: True}


def test_catalog_keeps_the_first_occurrence_in_order(spark):
    facts = ["Ticket count: 1,200", "Automation score: 88.00/100"]
    contexts = spark.createDataFrame(
        [
            (
                2**63 - 1,
                [(facts, ("a",), "Because.")],
                [("a", ["step", "step"], ["Inbox"], ["None"])],
                [("a", "Title", ["risk"], ["review"])],
                "- **X:** y\nz\n- **X:** y\n- **A:** b",
            )
        ],
        "batch_id bigint, categories array<struct<allowed_numeric_evidence:array<string>,metrics:struct<category:string>,"
        "deterministic_explanation:string>>, analyses array<struct<category:string,repetitive_steps:array<string>,"
        "systems_used:array<string>,exception_cases:array<string>>>, recommendations array<struct<category:string,"
        "title:string,risks:array<string>,human_review_points:array<string>>>, document string",
    )
    lines = ca.catalog_of(*map(F.col, ("categories", "analyses", "recommendations", "document")))
    out = ca.catalog_lines(contexts.select("batch_id", lines.alias("evidence_catalog"))).orderBy("line_no").collect()
    assert {r.batch_id for r in out} == {2**63 - 1}
    assert [r.line for r in out] == [
        *facts,
        "Deterministic ranking — a: Because.",
        "Process documentation — a — repetitive step: step",
        "Process documentation — a — system: Inbox",
        "Process documentation — a — exception: None",
        "Verified recommendation — a — title: Title",
        "Verified recommendation — a — risk: risk",
        "Verified recommendation — a — human review: review",
        "Process documentation — **X:** y",
        "Process documentation — **A:** b",
    ]
