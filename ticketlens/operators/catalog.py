"""The catalog of lines that a chat answer may cite: one for each audit result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens import fixed_values as fixed
from ticketlens.sources.documents import bullet_lines


def ranking_line(category: Column, explanation: Column) -> Column:
    return F.concat(F.lit(fixed.CATALOG_RANKING), category, F.lit(": "), explanation)


def _prefixed(values: Column, prefix: str, category: Column, middle: str) -> Column:
    return F.transform(
        values, lambda v: F.concat(F.lit(prefix), category, F.lit(f" — {middle}: "), v)
    )


def category_entry_lines(entry: Column) -> Column:
    """Fact lines and ranking line of one category of a company's evidence."""
    return F.concat(
        entry["allowed_numeric_evidence"],
        F.array(ranking_line(entry["metrics"]["category"], entry["deterministic_explanation"])),
    )


def analysis_entry_lines(entry: Column) -> Column:
    """Lines of one process analysis given as a struct."""
    kinds = {
        "repetitive_steps": fixed.CATALOG_STEP,
        "systems_used": fixed.CATALOG_SYSTEM,
        "exception_cases": fixed.CATALOG_EXCEPTION,
    }
    return F.concat(
        *(
            _prefixed(entry[field], fixed.CATALOG_PROCESS, entry["category"], middle)
            for field, middle in kinds.items()
        )
    )


def recommendation_entry_lines(entry: Column) -> Column:
    """Lines of one verified recommendation given as a struct."""
    category, prefix = entry["category"], fixed.CATALOG_RECOMMENDATION
    return F.concat(
        _prefixed(F.array(entry["title"]), prefix, category, fixed.CATALOG_TITLE),
        _prefixed(entry["risks"], prefix, category, fixed.CATALOG_RISK),
        _prefixed(entry["human_review_points"], prefix, category, fixed.CATALOG_REVIEW),
    )


def catalog_of(categories: Column, analyses: Column, recommendations: Column, document: Column) -> Column:
    """The distinct lines of one audit result, in order of their first occurrence."""
    return F.array_distinct(
        F.concat(
            F.flatten(F.transform(categories, category_entry_lines)),
            F.flatten(F.transform(analyses, analysis_entry_lines)),
            F.flatten(F.transform(recommendations, recommendation_entry_lines)),
            bullet_lines(document),
        )
    )


def catalog_lines(contexts: DataFrame) -> DataFrame:
    """Catalogs laid out flat: ``(batch_id, line_no, line)``. Every row stays where it is."""
    return contexts.select("batch_id", F.posexplode("evidence_catalog").alias("line_no", "line"))
