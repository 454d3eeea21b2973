"""Check of drafted recommendations against the evidence of their company."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens import fixed_values as fixed
from ticketlens.errors import GroundingError
from ticketlens.functions.text import has_digit

_NARRATIVE = (
    "title",
    "current_workflow",
    "proposed_automation",
    "expected_benefits",
    "assumptions",
    "risks",
    "human_review_points",
)


def verify_recommendations(
    drafts: DataFrame, evidence: DataFrame, *, limit: int = fixed.BATCH_LIMIT
) -> DataFrame:
    """Add ``verdict`` and ``issue`` to the first ``limit`` drafts of each batch.

    ``evidence`` has one row per (company_id, category) with the array
    ``allowed_numeric_evidence``. A draft is a duplicate if an earlier draft of its
    batch and category was accepted; because a draft's own checks do not depend on
    the others, that is the case exactly if an earlier one passed its own checks.
    Only ``limit`` rows of a batch reach the window, however long the batch.
    """
    allowed = evidence.select("company_id", "category", "allowed_numeric_evidence")
    # concat_ws takes texts and arrays alike; the line feed keeps words apart.
    narrative = F.concat_ws("\n", *_NARRATIVE)
    # Texts are judged before the join, so that a verdict alone moves no text.
    of_texts = F.when(has_digit(narrative), "numeric").when(
        F.lower(narrative).contains(fixed.FORBIDDEN_CLAIM), "guarantee"
    )
    own = (
        F.when(F.col("allowed_numeric_evidence").isNull(), "unsupported")
        .when(
            (F.size("evidence") < fixed.LEAST_LINES)
            | (F.size(F.array_except("evidence", "allowed_numeric_evidence")) > 0),
            "evidence",
        )
        .otherwise(F.coalesce("_of_texts", F.lit("accepted")))
    )
    judged = (
        drafts.filter(F.col("pos") < limit)
        .withColumn("_of_texts", of_texts)
        .join(allowed, ["company_id", "category"], "left")
        .withColumn("_own", own)
        .drop("allowed_numeric_evidence", "_of_texts")
    )
    # By batch alone: neither rows that are laid out by batch nor a later gate per batch move again.
    earlier = Window.partitionBy("batch_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.collect_set(F.when(F.col("_own") == "accepted", F.struct("category"))).over(earlier)
    accepted_before = F.exists("_taken", lambda t: t["category"].eqNullSafe(F.col("category")))
    verdict = (
        F.when(F.col("_own") == "unsupported", "unsupported")
        .when(accepted_before, "duplicate")
        .otherwise(F.col("_own"))
    )
    category = F.col("category")
    wording = {
        "unsupported": F.concat(F.lit(fixed.ISSUE_UNKNOWN_CATEGORY), category),
        "duplicate": F.concat(F.lit(fixed.ISSUE_DUPLICATE_CATEGORY), category),
        "evidence": F.concat(F.lit(fixed.ISSUE_REJECTED), category, F.lit(fixed.ISSUE_EVIDENCE)),
        "numeric": F.concat(F.lit(fixed.ISSUE_REJECTED), category, F.lit(fixed.ISSUE_NUMERIC)),
        "guarantee": F.concat(F.lit(fixed.ISSUE_REJECTED), category, F.lit(fixed.ISSUE_GUARANTEE)),
    }
    issue = F.lit(None).cast("string")
    for name, text in wording.items():
        issue = F.when(F.col("verdict") == name, text).otherwise(issue)
    return (
        judged.withColumn("_taken", taken).withColumn("verdict", verdict).drop("_own", "_taken").withColumn("issue", issue)
    )


def accepted(verified: DataFrame) -> DataFrame:
    return verified.filter(F.col("verdict") == "accepted").drop("verdict", "issue")


def issues(verified: DataFrame) -> DataFrame:
    return verified.filter(F.col("issue").isNotNull()).select(
        "batch_id", "company_id", "pos", "issue"
    )


def batch_gate(verified: DataFrame) -> DataFrame:
    """Per batch: accepted and rejected counts; a batch without an accepted draft fails."""
    is_accepted = F.col("verdict") == "accepted"
    return (
        verified.groupBy("batch_id")
        .agg(
            F.count_if(is_accepted).alias("accepted"),
            F.count_if(~is_accepted).alias("rejected"),
        )
        .withColumn("ok", F.col("accepted") > 0)
    )


def require_accepted(gate: DataFrame) -> None:
    failed = gate.filter(~F.col("ok")).head()
    if failed is not None:
        raise GroundingError(
            f"No recommendations passed deterministic evidence validation: {failed['batch_id']}"
        )
