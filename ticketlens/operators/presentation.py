"""Tabular content of the overview: cards, tables, chart series and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.errors import DataContractError
from ticketlens.fixed_values import AXIS_HEADROOM, SCORE_AXIS_MAX
from ticketlens.functions.numbers import fixed, percent, thousands
from ticketlens.functions.text import title
from ticketlens.operators.scoring import score_band


def metrics_table(scored_metrics: DataFrame) -> DataFrame:
    return scored_metrics.select(
        "company_id",
        "position",
        title(F.col("category")).alias("category_title"),
        "ticket_count",
        "category_percentage",
        "average_resolution_minutes",
        "total_handling_hours",
        (F.col("escalation_rate") * F.lit(100.0)).alias("escalation_percentage"),
        "automation_score",
    )


def ranking_cards(opportunities: DataFrame) -> DataFrame:
    """One row per ranked category with its band and one-line figures."""
    score = F.col("automation_score")
    return opportunities.select(
        "company_id",
        "rank",
        title(F.col("category")).alias("category_title"),
        fixed(score, 1).alias("score_text"),
        score_band(score).alias("band"),
        F.concat(
            F.lit("Volume "),
            thousands(F.col("ticket_count")),
            F.lit(" · Avg. resolution "),
            fixed(F.col("average_resolution_minutes"), 1),
            F.lit(" min · Escalation "),
            percent(F.col("escalation_rate"), 1),
        ).alias("figures"),
        F.regexp_replace("explanation", r"\.\z", "").alias("rationale"),
    )


def headline_cards(overall: DataFrame, extremes: DataFrame) -> DataFrame:
    """Five cards per company: ``(company_id, card_no, label, value, support)``."""

    def card(number: int, label: str, value: Column, support: Column) -> Column:
        return F.struct(
            F.lit(number).alias("card_no"),
            F.lit(label).alias("label"),
            value.alias("value"),
            support.alias("support"),
        )

    cards = [
        card(1, "Total tickets", thousands(F.col("total_ticket_count")), F.lit("All recorded tickets")),
        card(
            2,
            "Handling hours",
            fixed(F.col("total_handling_hours"), 1, grouped=True),
            F.lit("Recorded resolution effort"),
        ),
        card(
            3,
            "Escalation rate",
            percent(F.col("overall_escalation_rate"), 1),
            F.lit("Share requiring escalation"),
        ),
        card(
            4,
            "Highest-volume category",
            title(F.col("volume_category")),
            F.concat(thousands(F.col("volume_count")), F.lit(" tickets")),
        ),
        card(
            5,
            "Top automation opportunity",
            title(F.col("score_category")),
            F.concat(fixed(F.col("top_score"), 1), F.lit(" out of 100")),
        ),
    ]
    return overall.join(extremes, "company_id").select("company_id", F.inline(F.array(*cards)))


def chart_series(scored_metrics: DataFrame) -> DataFrame:
    """Bars of the three charts: ``(company_id, chart, pos, label, value, gradient_pos, axis_max)``."""
    charts = F.array(
        *(
            F.struct(F.lit(chart).alias("chart"), F.col(column).cast("double").alias("value"))
            for chart, column in (
                ("volume", "ticket_count"),
                ("hours", "total_handling_hours"),
                ("score", "automation_score"),
            )
        )
    )
    # Metrics arrive partitioned by company, which also serves (company, chart):
    # the windows add sorts but no exchange.
    bars = scored_metrics.select("company_id", "category", F.inline(charts))
    chart = Window.partitionBy("company_id", "chart")
    pos = F.row_number().over(chart.orderBy(F.desc("value"), "category")) - 1
    steps = F.greatest(F.count(F.lit(1)).over(chart) - 1, F.lit(1))
    axis = F.when(F.col("chart") == "score", F.lit(SCORE_AXIS_MAX)).otherwise(
        F.max("value").over(chart) * F.lit(AXIS_HEADROOM)
    )
    return bars.select(
        "company_id",
        "chart",
        pos.alias("pos"),
        title(F.col("category")).alias("label"),
        "value",
        (pos.cast("double") / steps).alias("gradient_pos"),
        axis.alias("axis_max"),
    )


def require_categories(scored_metrics: DataFrame) -> DataFrame:
    if scored_metrics.isEmpty():
        raise DataContractError("At least one category is required to build a chart")
    return scored_metrics


def company_captions(companies: DataFrame) -> DataFrame:
    month = "MMM yyyy"
    return companies.select(
        F.col("id").alias("company_id"),
        F.concat_ws(
            " · ",
            "demo_status",
            "industry",
            F.concat(
                F.date_format("reporting_period_start", month),
                F.lit("–"),
                F.date_format("reporting_period_end", month),
            ),
            F.concat(thousands(F.col("ticket_count")), F.lit(" tickets")),
        ).alias("caption"),
    )


def ticket_order(tickets: DataFrame) -> DataFrame:
    """All tickets by time and id: a range-partitioned sort, no single-task merge."""
    return tickets.orderBy("created_at", "ticket_id")
