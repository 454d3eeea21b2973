"""Coverage of process analyses, merged limitations and completeness of results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.errors import GroundingError


def process_coverage(analyses: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per batch: does it hold exactly one analysis of every audited category?

    ``analyses`` has (batch_id, company_id, category). Two key sets are equal and
    their counts agree exactly if no entry is unknown and the known distinct ones
    and all entries number as many as the audited categories.
    """
    audited = metrics.select("company_id", "category", F.lit(True).alias("_audited"))
    expected = metrics.groupBy("company_id").agg(F.count(F.lit(1)).alias("expected"))
    per_category = analyses.groupBy("batch_id", "company_id", "category").agg(
        F.count(F.lit(1)).alias("_rows")
    )
    per_batch = (
        per_category.join(audited, ["company_id", "category"], "left")
        .groupBy("batch_id", "company_id")
        .agg(
            F.sum("_rows").alias("entries"),
            F.count("_audited").alias("covered"),
            F.count_if(F.col("_audited").isNull()).alias("unexpected"),
        )
    )
    # A company without any batch is kept: nothing covers its categories. It shows in the batches
    # already counted, so analyses are read once. A full outer join would say this too, but
    # could not split a company with very many batches.
    idle = expected.join(per_batch.select("company_id").distinct(), "company_id", "left_anti")
    zero = F.lit(0).cast("bigint")
    return (
        per_batch.join(expected, "company_id", "left")
        .unionByName(idle, allowMissingColumns=True)
        .select(
            "batch_id",
            "company_id",
            *(
                F.coalesce(name, zero).alias(name)
                for name in ("expected", "entries", "covered", "unexpected")
            ),
        )
        .withColumn("missing", F.col("expected") - F.col("covered"))
        .withColumn(
            "ok",
            (F.col("missing") == 0)
            & (F.col("unexpected") == 0)
            & (F.col("entries") == F.col("expected")),
        )
    )


def require_coverage(coverage: DataFrame) -> None:
    if coverage.filter(~F.col("ok")).head() is not None:
        raise GroundingError(
            "Process analysis must contain exactly one entry for every audited category."
        )


def batch_issues(verified: DataFrame) -> DataFrame:
    """Issues per batch in order of position; at most one per checked position."""
    entry = F.struct("pos", "issue")
    ordered = F.array_sort(F.collect_list(F.when(F.col("issue").isNotNull(), entry)))
    return verified.groupBy("batch_id").agg(F.transform(ordered, lambda e: e["issue"]).alias("issues"))


def merged_limitations(narratives: DataFrame, verified: DataFrame) -> DataFrame:
    """Limitations of a refined report: the narrative's own, then the batch's issues.

    ``narratives`` has (batch_id, limitations); its further columns are kept.
    """
    empty = F.array().cast("array<string>")
    merged = F.concat(F.coalesce("limitations", empty), F.coalesce("issues", empty))
    return (
        narratives.join(batch_issues(verified), "batch_id", "left").withColumn("limitations", merged).drop("issues")
    )


def staged_issues(recommendations: DataFrame, questions: DataFrame) -> DataFrame:
    """Issues of both checks as flat rows; the recommendation stage comes first."""
    stages = ((1, "recommendations", recommendations), (2, "questions", questions))
    parts = [
        verified.filter(F.col("issue").isNotNull()).select(
            "batch_id",
            F.lit(number).alias("stage_no"),
            F.lit(stage).alias("stage"),
            "pos",
            "issue",
        )
        for number, stage, verified in stages
    ]
    return parts[0].unionByName(parts[1])


def result_completeness(batches: DataFrame, parts: Mapping[str, DataFrame]) -> DataFrame:
    """Per batch, the number of required parts that are absent.

    ``batches`` and every part carry ``batch_id``. Parts are tagged, united and
    counted in one aggregation instead of being joined one after another.
    """
    tagged = batches.select("batch_id", F.lit("_batch").alias("part"))
    for name, frame in parts.items():
        tagged = tagged.unionByName(frame.select("batch_id", F.lit(name).alias("part")))
    held = tagged.groupBy("batch_id").agg(
        *(F.max(F.col("part") == name).alias(name) for name in ("_batch", *parts))
    )
    absent = sum(((~F.col(name)).cast("int") for name in parts), F.lit(0))
    return (
        held.filter("_batch")
        .drop("_batch")
        .withColumn("missing_parts", absent)
        .withColumn("ok", F.col("missing_parts") == 0)
    )


def require_complete(completeness: DataFrame) -> None:
    if completeness.filter(~F.col("ok")).head() is not None:
        raise GroundingError("A result lacks a required part.")
