"""Volume, effort, escalation and mix metrics per company.

All metrics are read from one pre-aggregated cube over company and the dimensions
in use. The cube is the only place where tickets are shuffled, and only after
partial sums: a company or category that holds most of the rows reaches the shuffle
as a few rows. Coarser groupings add the cube's sums up, exactly, since counts and
minutes are kept as integers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions.numbers import limb_columns, limb_resums, limb_total, ratio, round_exact
from ticketlens.operators.ordering import numbered

DIMENSIONS = ("category", "channel", "customer_tier")


def ticket_cube(tickets: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    return tickets.groupBy("company_id", *dimensions).agg(
        F.count(F.lit(1)).alias("ticket_count"),
        F.sum(F.col("escalated").cast("int")).alias("escalated_count"),
        *limb_columns(F.col("resolution_minutes"), "minutes"),
    )


def _resums():
    return [
        F.sum("ticket_count").alias("ticket_count"),
        F.sum("escalated_count").alias("escalated_count"),
        *limb_resums("minutes"),
    ]


def merged_cube(cubes: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Cubes of parts of the tickets added up; equals the cube of all of them."""
    return cubes.groupBy("company_id", *dimensions).agg(*_resums())


def _measures() -> dict:
    minutes = limb_total("minutes")
    return {
        "average_resolution_minutes": minutes / F.col("ticket_count"),
        "total_handling_hours": minutes / F.lit(60.0),
        "escalation_rate": F.col("escalated_count").cast("double") / F.col("ticket_count"),
    }


def overall_metrics(cube: DataFrame) -> DataFrame:
    """Totals per company: count, hours (2 digits) and escalation rate (6 digits)."""
    measures = _measures()
    return (
        cube.groupBy("company_id")
        .agg(*_resums())
        .select(
            "company_id",
            F.col("ticket_count").alias("total_ticket_count"),
            round_exact(measures["total_handling_hours"], 2).alias("total_handling_hours"),
            round_exact(measures["escalation_rate"], 6).alias("overall_escalation_rate"),
        )
    )


def category_metrics(cube: DataFrame) -> DataFrame:
    """One row per company and category, with the canonical ``position``.

    The windows run over one row per category, not over tickets.
    """
    company = Window.partitionBy("company_id")
    canonical = company.orderBy(F.desc("ticket_count"), "category")
    total = F.sum("ticket_count").over(company)
    return (
        cube.groupBy("company_id", "category")
        .agg(*_resums())
        .select(
            "company_id",
            "category",
            "ticket_count",
            (F.col("ticket_count") * F.lit(100.0) / total).alias("category_percentage"),
            *(expression.alias(name) for name, expression in _measures().items()),
            F.max("ticket_count").over(company).alias("maximum_category_count"),
            F.row_number().over(canonical).alias("position"),
        )
    )


def category_shares(cube: DataFrame) -> DataFrame:
    company = Window.partitionBy("company_id")
    counted = cube.groupBy("company_id", "category").agg(
        F.sum("ticket_count").alias("ticket_count")
    )
    total = F.sum("ticket_count").over(company)
    return counted.select(
        "company_id",
        "category",
        "ticket_count",
        (F.col("ticket_count") * F.lit(100.0) / total).alias("category_percentage"),
        F.max("ticket_count").over(company).alias("maximum_category_count"),
    )


def volume_ratios(shares: DataFrame) -> DataFrame:
    return shares.select(
        "company_id",
        "category",
        ratio(F.col("ticket_count"), F.col("maximum_category_count")).alias("volume_ratio"),
    )


def escalation_rates(cube: DataFrame) -> DataFrame:
    return (
        cube.groupBy("company_id", "category")
        .agg(F.sum("ticket_count").alias("n"), F.sum("escalated_count").alias("escalated"))
        .select("company_id", "category", (F.col("escalated") / F.col("n")).alias("escalation_rate"))
    )


def dimension_counts(cube: DataFrame, dimension: str) -> DataFrame:
    """Tickets per value of a dimension in canonical order (``position``).

    A dimension may have any number of values, so positions come from a range sort.
    """
    counted = cube.groupBy("company_id", F.col(dimension).alias("value")).agg(
        F.sum("ticket_count").alias("ticket_count")
    )
    return numbered(counted, ["company_id"], [F.desc("ticket_count"), F.col("value")], "position")


def support_summary(cube: DataFrame) -> DataFrame:
    """Totals, category, channel and tier rows of every company from one cube.

    ``level`` names the grouping. The grouping sets expand the small cube, not the
    tickets.
    """
    category, channel, tier = DIMENSIONS
    sets = [["company_id"], *(["company_id", dimension] for dimension in DIMENSIONS)]
    level = (
        F.when(F.grouping(category) == 0, category)
        .when(F.grouping(channel) == 0, channel)
        .when(F.grouping(tier) == 0, tier)
        .otherwise("company")
    )
    return (
        cube.groupingSets(sets, "company_id", *DIMENSIONS)
        .agg(level.alias("level"), *_resums())
        .select(
            "company_id",
            "level",
            F.coalesce(category, channel, tier).alias("value"),
            "ticket_count",
            *(expression.alias(name) for name, expression in _measures().items()),
        )
    )
