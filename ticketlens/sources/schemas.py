"""Declared schemas of the input tables."""

from __future__ import annotations

from pyspark.sql import types as T

from ticketlens.fixed_values import TICKET_COLUMNS


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_TEXT = T.StringType()
_TEXTS = T.ArrayType(_TEXT)

RAW_TICKET = _struct(*((name, _TEXT) for name in TICKET_COLUMNS))

TICKET = _struct(
    ("company_id", _TEXT),
    ("ticket_id", _TEXT),
    ("created_at", T.TimestampType()),
    ("category", _TEXT),
    ("description", _TEXT),
    ("resolution_minutes", T.DoubleType()),
    ("escalated", T.BooleanType()),
    ("channel", _TEXT),
    ("customer_tier", _TEXT),
)

COMPANY = _struct(
    ("id", _TEXT),
    ("name", _TEXT),
    ("industry", _TEXT),
    ("description", _TEXT),
    ("headquarters", _TEXT),
    ("support_team_size", T.LongType()),
    ("support_hours", _TEXT),
    ("reporting_period_start", T.DateType()),
    ("reporting_period_end", T.DateType()),
    ("disclaimer", _TEXT),
    ("ticket_count", T.LongType()),
    ("demo_status", _TEXT),
)

FACTORS = _struct(
    ("category", _TEXT),
    ("repetitiveness", T.DoubleType()),
    ("process_consistency", T.DoubleType()),
)

RECOMMENDATION = _struct(
    ("category", _TEXT),
    ("title", _TEXT),
    ("current_workflow", _TEXT),
    ("proposed_automation", _TEXT),
    ("evidence", _TEXTS),
    ("expected_benefits", _TEXTS),
    ("assumptions", _TEXTS),
    ("risks", _TEXTS),
    ("human_review_points", _TEXTS),
    ("confidence", _TEXT),
)

QUESTION = _struct(
    ("question_id", _TEXT),
    ("question", _TEXT),
    ("rationale", _TEXT),
    ("related_categories", _TEXTS),
    ("required", T.BooleanType()),
)

PROCESS_ANALYSIS = _struct(
    ("category", _TEXT),
    ("repetitive_steps", _TEXTS),
    ("systems_used", _TEXTS),
    ("exception_cases", _TEXTS),
    ("human_approval_required", T.BooleanType()),
    ("observations", _TEXTS),
)

NARRATIVE = _struct(("executive_summary", _TEXT), ("limitations", _TEXTS))

CHAT_ANSWER = _struct(
    ("answer", _TEXT),
    ("evidence_used", _TEXTS),
    ("assumptions", _TEXTS),
    ("missing_information", _TEXTS),
)

RECOMMENDATION_BATCH = _struct(("recommendations", T.ArrayType(RECOMMENDATION)))
QUESTION_BATCH = _struct(("questions", T.ArrayType(QUESTION)))
PROCESS_ANALYSIS_BATCH = _struct(("analyses", T.ArrayType(PROCESS_ANALYSIS)))
