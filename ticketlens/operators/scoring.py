"""Automation score, ranking, explanations and extremes.

Input is one row per company and category; all windows share the company as
partition key, so the rows are exchanged once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens import fixed_values as fixed
from ticketlens.errors import DataContractError
from ticketlens.functions.numbers import clamp, ratio, round_exact


def with_factors(metrics: DataFrame, factors: DataFrame) -> DataFrame:
    """Left join on category; ``has_factors`` is false where no factors are known."""
    known = factors.withColumn("has_factors", F.lit(True))
    return metrics.join(known, "category", "left").withColumn(
        "has_factors", F.coalesce("has_factors", F.lit(False))
    )


def require_factors(joined: DataFrame) -> DataFrame:
    unknown = joined.filter(~F.col("has_factors")).select("company_id", "category").head()
    if unknown is not None:
        raise DataContractError(f"No factors for category: {unknown['category']}")
    return joined


def automation_score(weights: Mapping[str, float] = fixed.SCORE_WEIGHTS) -> Column:
    """Score 0..100 from the five weighted terms, added in their listed order."""
    volume = ratio(F.col("ticket_count"), F.col("maximum_category_count"))
    handling = clamp(
        F.greatest(F.col("average_resolution_minutes"), F.lit(0.0))
        / F.lit(float(fixed.FULL_HANDLING_MINUTES)),
        0,
        1,
    )
    suitability = F.lit(1.0) - clamp(F.col("escalation_rate"), 0, 1)
    terms = {
        "volume_weight": volume,
        "repetitiveness_weight": F.col("repetitiveness"),
        "handling_time_weight": handling,
        "escalation_weight": suitability,
        "process_consistency_weight": F.col("process_consistency"),
    }
    weighted = [F.lit(float(weights[name])) * term for name, term in terms.items()]
    total = weighted[0]
    for term in weighted[1:]:
        total = total + term
    return round_exact(clamp(F.lit(100.0) * total, 0, 100), 2)


def scored(metrics: DataFrame, factors: DataFrame, **kwargs) -> DataFrame:
    return with_factors(metrics, factors).withColumn("automation_score", automation_score(**kwargs))


def explanation() -> Column:
    """Reason fragments in fixed order; ``concat_ws`` leaves out those that do not apply."""
    volume = ratio(F.col("ticket_count"), F.col("maximum_category_count"))
    repetitiveness = F.col("repetitiveness")
    consistency = F.col("process_consistency")
    escalation = F.col("escalation_rate")
    fragments = [
        F.when(volume >= fixed.HIGH_VOLUME_FROM, fixed.HIGH_VOLUME)
        .when(volume >= fixed.MODERATE_VOLUME_FROM, fixed.MODERATE_VOLUME)
        .otherwise(fixed.LOW_VOLUME),
        F.when(repetitiveness >= fixed.HIGH_REPETITION_FROM, fixed.HIGH_REPETITION).when(
            repetitiveness < fixed.LOW_REPETITION_BELOW, fixed.LOW_REPETITION
        ),
        F.when(
            F.col("average_resolution_minutes") >= fixed.LONG_HANDLING_FROM, fixed.LONG_HANDLING
        ),
        F.when(escalation >= fixed.HIGH_ESCALATION_FROM, fixed.HIGH_ESCALATION).when(
            escalation <= fixed.LOW_ESCALATION_UP_TO, fixed.LOW_ESCALATION
        ),
        F.when(consistency < fixed.LOW_CONSISTENCY_BELOW, fixed.LOW_CONSISTENCY).when(
            consistency >= fixed.HIGH_CONSISTENCY_FROM, fixed.HIGH_CONSISTENCY
        ),
    ]
    return F.concat(F.concat_ws("; ", *fragments), F.lit("."))


def ranked(scored_metrics: DataFrame) -> DataFrame:
    """Add ``rank`` (score descending, then category) and ``explanation``."""
    order = Window.partitionBy("company_id").orderBy(F.desc("automation_score"), "category")
    return scored_metrics.withColumn("rank", F.row_number().over(order)).withColumn(
        "explanation", explanation()
    )


def _first(frame: DataFrame, *order) -> DataFrame:
    window = Window.partitionBy("company_id").orderBy(*order)
    return frame.withColumn("_place", F.row_number().over(window)).filter("_place = 1").drop("_place")


def highest_volume(metrics: DataFrame) -> DataFrame:
    """Largest category of each company; a tie goes to the alphabetically last."""
    return _first(metrics, F.desc("ticket_count"), F.desc("category")).select(
        "company_id", "category", "ticket_count"
    )


def highest_automation(opportunities: DataFrame) -> DataFrame:
    return opportunities.filter(F.col("rank") == 1).select(
        "company_id", "category", "automation_score"
    )


def overview_extremes(scored_metrics: DataFrame) -> DataFrame:
    """First maxima in canonical order: volume and score leaders of the overview."""
    company = Window.partitionBy("company_id")
    by_volume = company.orderBy(F.desc("ticket_count"), "category")
    by_score = company.orderBy(F.desc("automation_score"), F.desc("ticket_count"), "category")
    placed = scored_metrics.select(
        "company_id",
        "category",
        "ticket_count",
        "automation_score",
        (F.row_number().over(by_volume) == 1).alias("_first_volume"),
        (F.row_number().over(by_score) == 1).alias("_first_score"),
    )

    def pick(flag: str, column: str) -> Column:
        return F.max(F.when(F.col(flag), F.col(column)))

    return placed.groupBy("company_id").agg(
        pick("_first_volume", "category").alias("volume_category"),
        pick("_first_volume", "ticket_count").alias("volume_count"),
        pick("_first_score", "category").alias("score_category"),
        pick("_first_score", "automation_score").alias("top_score"),
    )


def top_opportunities(opportunities: DataFrame, count: int = 3) -> DataFrame:
    return opportunities.filter(F.col("rank") <= count)


def remaining_opportunities(opportunities: DataFrame, count: int = 3) -> DataFrame:
    return opportunities.filter(F.col("rank") > count)


def score_band(score: Column) -> Column:
    (high, strong), (middle, moderate) = fixed.SCORE_BANDS
    return (
        F.when(score >= high, strong).when(score >= middle, moderate).otherwise(fixed.LOWEST_BAND)
    )
