"""Machine-written documents: parsing, declared bounds and whole-batch gates.

A batch of recommendations or questions arrives as one JSON text and is parsed
inside its row. The flat form has one row per entry with its place ``pos``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.errors import GroundingError
from ticketlens.fixed_values import (
    BATCH_LIMIT,
    CHAT_ROLES,
    CONFIDENCE_LEVELS,
    QUESTION_ID_PATTERN,
)

_FINDING = "array<struct<path: string, expected: string, found: string>>"
_KINDS = {T.StringType(): "STRING", T.BooleanType(): "BOOLEAN"}


def _finding(path: Column, expected: str, found: Column) -> Column:
    held = F.struct(path.alias("path"), F.lit(expected).alias("expected"), found.cast("string").alias("found"))
    return F.array(held).cast(_FINDING)


def type_findings(kind: T.DataType, value: Column, path: Column, *, required: bool = False) -> Column:
    """What of a VARIANT value isn't as declared: path, expected and found kind, one entry per place.

    Nulls and absent fields are findings only where ``required``, the others are left to the bounds. Fields that
    aren't declared are no findings. Nothing is converted: a number isn't a text.
    """
    found = F.schema_of_variant(value)
    none = F.array().cast(_FINDING)
    if isinstance(kind, T.StructType):
        expected, fits = "OBJECT", found.startswith("OBJECT")
        inner = F.concat(
            *(
                type_findings(f.dataType, F.try_variant_get(value, f"$.{f.name}", "variant"), F.concat(path, F.lit(f".{f.name}")))
                for f in kind.fields
            )
        )
    elif isinstance(kind, T.ArrayType):
        expected, fits = "ARRAY", found.startswith("ARRAY")
        entries = F.try_variant_get(value, "$", "array<variant>")
        inner = F.flatten(
            F.transform(
                entries,
                lambda e, i: type_findings(kind.elementType, e, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))),
            )
        )
    else:
        expected, inner = _KINDS[kind], none
        fits = found == expected
    absent = found.isNull() | (found == "VOID")
    return (
        F.when(absent, _finding(path, expected, found) if required else none)
        .when(fits, F.coalesce(inner, none))
        .otherwise(_finding(path, expected, F.regexp_extract(found, "^[A-Z]+", 0)))
    )


def parse_documents(drafts: DataFrame, schema: T.StructType, column: str = "document") -> DataFrame:
    """Add ``parsed``, ``findings`` and ``status`` (``ok``, ``malformed``); unreadable texts keep their row.

    A text is read once, into a VARIANT; a document is malformed if there is any finding. The finding of a text
    that is null or no JSON has the path ``$``.
    """
    whole = F.col("_variant")
    held = F.concat(
        *(
            type_findings(f.dataType, F.try_variant_get(whole, f"$.{f.name}", "variant"), F.lit(f.name), required=True)
            for f in schema.fields
        )
    )
    readable = F.schema_of_variant(whole).startswith("OBJECT")
    unreadable = _finding(F.lit("$"), "OBJECT", F.regexp_extract(F.schema_of_variant(whole), "^[A-Z]+", 0))
    fields = F.try_variant_get(whole, "$", schema.simpleString())
    return (
        drafts.withColumn("_variant", F.try_parse_json(column))
        .withColumn("findings", F.when(readable, held).otherwise(unreadable))
        .withColumn("status", F.when(F.size("findings") > 0, "malformed").otherwise("ok"))
        .withColumn("parsed", F.when(F.col("status") == "ok", fields))
        .drop("_variant")
    )


def document_findings(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row ``(*keys, path, expected, found)`` for each place of a document that isn't as declared."""
    return parsed.select(*keys, F.explode("findings").alias("_finding")).select(*keys, "_finding.*")


def explode_batch(parsed: DataFrame, keys: Sequence[str], entries: str) -> DataFrame:
    """Entries of the readable batches as flat rows ``(*keys, pos, fields…)``.

    A question that doesn't say so is not required.
    """
    rows = (
        parsed.filter(F.col("status") == "ok")
        .select(*keys, F.posexplode(f"parsed.{entries}").alias("pos", "_entry"))
        .select(*keys, "pos", "_entry.*")
    )
    return rows.fillna(False, ["required"]) if "required" in rows.columns else rows


def single_entries(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Readable documents that are one entry each, as flat rows ``(*keys, fields…)``."""
    return parsed.filter(F.col("status") == "ok").select(*keys, "parsed.*")


def _filled(name: str) -> Column:
    return F.length(name) >= 1


def _some(name: str) -> Column:
    return F.size(name) >= 1


def recommendation_bounds() -> dict[str, Column]:
    texts = ("title", "current_workflow", "proposed_automation")
    lists = ("evidence", "expected_benefits", "assumptions", "risks", "human_review_points")
    return {
        "category": F.col("category").isNotNull(),
        **{name: _filled(name) for name in texts},
        **{name: _some(name) for name in lists},
        "confidence": F.col("confidence").isin(*CONFIDENCE_LEVELS),
    }


def question_bounds() -> dict[str, Column]:
    return {
        "question_id": F.col("question_id").rlike(QUESTION_ID_PATTERN.replace("$", r"\z")),
        "question": F.length("question") >= 10,
        "rationale": F.length("rationale") >= 10,
        "related_categories": _some("related_categories"),
    }


def turn_bounds() -> dict[str, Column]:
    return {"role": F.col("role").isin(*CHAT_ROLES), "content": F.col("content").isNotNull()}


def analysis_bounds() -> dict[str, Column]:
    lists = ("repetitive_steps", "systems_used", "exception_cases", "observations")
    return {
        name: F.col(name).isNotNull() for name in ("category", "human_approval_required", *lists)
    }


def narrative_bounds() -> dict[str, Column]:
    return {"executive_summary": _filled("executive_summary"), "limitations": _some("limitations")}


def chat_answer_bounds() -> dict[str, Column]:
    lists = ("evidence_used", "assumptions", "missing_information")
    return {"answer": _filled("answer"), **{name: F.col(name).isNotNull() for name in lists}}


def with_broken_bounds(rows: DataFrame, bounds: dict[str, Column]) -> DataFrame:
    """Add ``broken``: names of the fields that break their bound, null included."""
    broken = [
        F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in bounds.items()
    ]
    return rows.withColumn("broken", F.array_compact(F.array(*broken)))


def batch_contract(
    rows: DataFrame, bounds: dict[str, Column], keys: Sequence[str], limit: int | None = BATCH_LIMIT
) -> DataFrame:
    """One row per batch: its entries, broken entries and whether the whole batch stands.

    A partial aggregation: a batch with any number of rows is never gathered.
    """
    counted = (
        with_broken_bounds(rows, bounds)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.count_if(F.size("broken") > 0).alias("broken_entries"),
        )
    )
    fits = F.lit(True) if limit is None else F.col("entries") <= limit
    return counted.withColumn("ok", fits & (F.col("broken_entries") == 0))


def standing_batches(rows: DataFrame, contract: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batches that stand as a whole."""
    return rows.join(contract.filter("ok").select(*keys), list(keys), "left_semi")


def require_documents_ok(parsed: DataFrame) -> DataFrame:
    if parsed.filter(F.col("status") != "ok").head() is not None:
        raise GroundingError("A document did not match its schema.")
    return parsed
