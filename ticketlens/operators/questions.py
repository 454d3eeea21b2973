"""Check of drafted clarification questions and of the answers given to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens import fixed_values as fixed
from ticketlens.errors import GroundingError
from ticketlens.functions.text import has_digit, mentions_any, strip


def company_categories(evidence: DataFrame) -> DataFrame:
    """Audited categories per company as an array, at most one entry per factor row."""
    return evidence.groupBy("company_id").agg(F.collect_set("category").alias("known_categories"))


def verify_questions(
    drafts: DataFrame, categories: DataFrame, *, limit: int = fixed.BATCH_LIMIT
) -> DataFrame:
    """Add ``verdict`` and ``issue`` to the first ``limit`` questions of each batch."""
    question = F.col("question")
    known = F.coalesce("known_categories", F.array().cast("array<string>"))
    # Texts are judged before the join, so that a verdict alone moves no text.
    of_text = (
        F.when(mentions_any(question, fixed.KNOWN_METRIC_REQUESTS), "known metric")
        .when(mentions_any(question, fixed.VAGUE_QUESTIONS), "vague")
        .when(mentions_any(question, fixed.DOCUMENTED_REQUESTS), "documented")
    )
    unknown = F.size(F.array_except("related_categories", known)) > 0
    own = F.coalesce("_of_text", F.when(unknown, "unsupported"), F.lit("accepted"))
    judged = (
        drafts.filter(F.col("pos") < limit)
        .withColumn("_of_text", of_text)
        .join(categories, "company_id", "left")
        .withColumn("_own", own)
        .drop("known_categories", "_of_text")
    )
    # By batch alone, as rows that are laid out by batch then stay where they are.
    earlier = Window.partitionBy("batch_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.collect_set(F.when(F.col("_own") == "accepted", F.struct("question_id"))).over(earlier)
    accepted_before = F.exists("_taken", lambda t: t["question_id"].eqNullSafe(F.col("question_id")))
    wording = {
        "duplicate": fixed.ISSUE_DUPLICATE_QUESTION,
        "known metric": fixed.ISSUE_KNOWN_METRIC,
        "vague": fixed.ISSUE_VAGUE,
        "documented": fixed.ISSUE_DOCUMENTED,
        "unsupported": fixed.ISSUE_QUESTION_CATEGORY,
    }
    issue = F.lit(None).cast("string")
    for name, text in wording.items():
        issue = F.when(
            F.col("verdict") == name, F.concat(F.lit(text), F.col("question_id"))
        ).otherwise(issue)
    return (
        judged.withColumn("_taken", taken)
        .withColumn("verdict", F.when(accepted_before, "duplicate").otherwise(F.col("_own")))
        .drop("_own", "_taken")
        .withColumn("issue", issue)
    )


def verify_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Judge stakeholder answers: ``dropped``, ``submission rejected`` or ``accepted``.

    ``answers`` has one (batch_id, question_id, answer) per question and ``questions``
    the accepted questions of each batch. Blank answers and answers to unknown ids are dropped;
    one answer that gives a number for a known metric rejects its whole submission.
    A submission answers questions of one batch, at most as many as its form has.
    """
    # Both sides by batch alone, so that the join and the window move each row once, or not at all if they are laid out so.
    # A batch has few accepted questions, so they are listed.
    asked = questions.groupBy("batch_id").agg(F.collect_list(F.struct("question_id", "question")).alias("_asked"))
    of_id = F.filter("_asked", lambda q: q["question_id"] == F.col("question_id"))
    answer = F.col("answer")
    judged = (
        answers.withColumn("answer", strip(answer))
        .join(asked, "batch_id", "left")
        .withColumn("_question", F.explode_outer(of_id))
        .withColumn("question", F.col("_question.question"))
        .drop("_asked", "_question")
        .withColumn("_kept", (F.length(answer) > 0) & F.col("question").isNotNull())
        .withColumn(
            "_contradiction",
            F.col("_kept")
            & has_digit(answer)
            & mentions_any(answer, fixed.CANONICAL_METRIC_TERMS),
        )
    )
    rejected = F.max("_contradiction").over(Window.partitionBy("batch_id"))
    verdict = (
        F.when(F.col("_rejected"), "submission rejected")
        .when(~F.col("_kept"), "dropped")
        .otherwise("accepted")
    )
    return (
        judged.withColumn("_rejected", rejected)
        .withColumn("verdict", verdict)
        .withColumn("issue", F.when(F.col("_rejected"), F.lit(fixed.ISSUE_CONTRADICTION)))
        .withColumn(
            "source_label",
            F.when(F.col("verdict") == "accepted", F.lit(fixed.STAKEHOLDER_LABEL)),
        )
        .drop("_kept", "_contradiction", "_rejected")
    )


def clarifications(verified_answers: DataFrame) -> DataFrame:
    """Accepted answers with ``pos``, their place in the submission."""
    return verified_answers.filter(F.col("verdict") == "accepted").select(
        "batch_id", "pos", "question_id", "question", "answer", "source_label"
    )


def require_answers(verified_answers: DataFrame) -> DataFrame:
    if verified_answers.filter(F.col("issue").isNotNull()).head() is not None:
        raise GroundingError(fixed.ISSUE_CONTRADICTION)
    return verified_answers
