"""Score and explanation as functions of SQL, which the optimizer writes out in place of each call."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from ticketlens import fixed_values as fixed

ARGUMENTS = (
    "ticket_count BIGINT, maximum_category_count BIGINT, average_resolution_minutes DOUBLE, "
    "escalation_rate DOUBLE, repetitiveness DOUBLE, process_consistency DOUBLE"
)
_VOLUME = (
    "CASE WHEN maximum_category_count <> 0 THEN CAST(ticket_count AS DOUBLE) / CAST(maximum_category_count AS DOUBLE) ELSE 0D END"
)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def score_text(weights: Mapping[str, float] = fixed.SCORE_WEIGHTS) -> str:
    terms = {
        "volume_weight": _VOLUME,
        "repetitiveness_weight": "repetitiveness",
        "handling_time_weight": f"least(greatest(greatest(average_resolution_minutes, 0D) / {float(fixed.FULL_HANDLING_MINUTES)!r}D, 0D), 1D)",
        "escalation_weight": "1D - least(greatest(escalation_rate, 0D), 1D)",
        "process_consistency_weight": "process_consistency",
    }
    total = " + ".join(f"{float(weights[name])!r}D * ({term})" for name, term in terms.items())
    return f"try_cast(format_number(least(greatest(100D * ({total}), 0D), 100D), '0.00') AS DOUBLE)"


def explanation_text() -> str:
    def case(*branches: tuple[str, str], otherwise: str | None = None) -> str:
        when = " ".join(f"WHEN {condition} THEN {_quoted(text)}" for condition, text in branches)
        return f"CASE {when}{f' ELSE {_quoted(otherwise)}' if otherwise else ''} END"

    parts = (
        case(
            (f"{_VOLUME} >= {fixed.HIGH_VOLUME_FROM!r}D", fixed.HIGH_VOLUME),
            (f"{_VOLUME} >= {fixed.MODERATE_VOLUME_FROM!r}D", fixed.MODERATE_VOLUME),
            otherwise=fixed.LOW_VOLUME,
        ),
        case(
            (f"repetitiveness >= {fixed.HIGH_REPETITION_FROM!r}D", fixed.HIGH_REPETITION),
            (f"repetitiveness < {fixed.LOW_REPETITION_BELOW!r}D", fixed.LOW_REPETITION),
        ),
        case((f"average_resolution_minutes >= {float(fixed.LONG_HANDLING_FROM)!r}D", fixed.LONG_HANDLING)),
        case(
            (f"escalation_rate >= {fixed.HIGH_ESCALATION_FROM!r}D", fixed.HIGH_ESCALATION),
            (f"escalation_rate <= {fixed.LOW_ESCALATION_UP_TO!r}D", fixed.LOW_ESCALATION),
        ),
        case(
            (f"process_consistency < {fixed.LOW_CONSISTENCY_BELOW!r}D", fixed.LOW_CONSISTENCY),
            (f"process_consistency >= {fixed.HIGH_CONSISTENCY_FROM!r}D", fixed.HIGH_CONSISTENCY),
        ),
    )
    return f"concat(concat_ws('; ', {', '.join(parts)}), '.')"


def register(spark: SparkSession, weights: Mapping[str, float] = fixed.SCORE_WEIGHTS) -> None:
    """Define ``automation_score`` and ``automation_explanation`` for the session's SQL; both take ``ARGUMENTS``.

    They equal ``scoring.automation_score`` and ``scoring.explanation``. Nulls in any argument of the score make it null.
    """
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION automation_score({ARGUMENTS}) RETURNS DOUBLE RETURN {score_text(weights)}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION automation_explanation({ARGUMENTS}) RETURNS STRING RETURN {explanation_text()}")
