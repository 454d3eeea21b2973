"""Evidence: fact lines, packages without ticket rows, leak checks, checksums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens import fixed_values as fv
from ticketlens.functions.numbers import fixed, percent, thousands
from ticketlens.session import staged

# Letters of the run by which a needle is looked up, and one in how many texts is asked how frequent such runs are.
GRAM = 4
SAMPLED = 64

METRIC_COLUMNS = (
    "category",
    "ticket_count",
    "category_percentage",
    "average_resolution_minutes",
    "total_handling_hours",
    "escalation_rate",
    "automation_score",
)


def fact_lines() -> Column:
    """The six fact lines of a category, as an array."""
    facts = (
        (fv.FACT_COUNT, thousands(F.col("ticket_count")), ""),
        (fv.FACT_PERCENTAGE, fixed(F.col("category_percentage"), 2), "%"),
        (fv.FACT_MINUTES, fixed(F.col("average_resolution_minutes"), 2), ""),
        (fv.FACT_HOURS, fixed(F.col("total_handling_hours"), 2), ""),
        (fv.FACT_ESCALATION, percent(F.col("escalation_rate"), 2), ""),
        (fv.FACT_SCORE, fixed(F.col("automation_score"), 2), "/100"),
    )
    return F.array(*(F.concat(F.lit(label), text, F.lit(end)) for label, text, end in facts))


def category_evidence(opportunities: DataFrame) -> DataFrame:
    """Ranked metrics with their explanation and allowed fact lines.

    A category without factors stops the job, so the categories of a company are
    never more than the rows of the factor table.
    """
    known = F.when(F.col("has_factors"), F.col("category")).otherwise(
        F.raise_error(F.concat(F.lit("No factors for category: "), "category")).cast("string")
    )
    return opportunities.select(
        "company_id",
        "rank",
        known.alias("category"),
        *METRIC_COLUMNS[1:],
        F.col("explanation").alias("deterministic_explanation"),
        fact_lines().alias("allowed_numeric_evidence"),
    )


def evidence_lines(opportunities: DataFrame) -> DataFrame:
    """Fact lines one per row: ``(company_id, category, rank, line_no, line)``."""
    return opportunities.select(
        "company_id", "category", "rank", F.posexplode(fact_lines()).alias("line_no", "line")
    )


def methodology(weights: Mapping[str, float] = fv.SCORE_WEIGHTS, note: str | None = None) -> Column:
    """The weights, and how they are put together: said by ``note``, else listed from the weights."""
    if note is None:
        note = "Weighted sum, 0 to 100: " + ", ".join(f"{name} {value:g}" for name, value in weights.items())
    return F.struct(
        *(F.lit(float(value)).alias(name) for name, value in weights.items()),
        F.lit(note).alias("note"),
    )


def company_evidence(evidence: DataFrame, overall: DataFrame, companies: DataFrame) -> DataFrame:
    """One row per company: company, totals, categories by rank and methodology.

    The collected list holds one entry per category of the factor table, which
    bounds it; no ticket row or text enters.
    """
    entry = F.struct(
        "rank",
        F.struct(*METRIC_COLUMNS).alias("metrics"),
        "deterministic_explanation",
        "allowed_numeric_evidence",
    )
    categories = evidence.groupBy("company_id").agg(
        F.array_sort(F.collect_list(entry)).alias("categories")
    )
    summary = overall.select(
        "company_id",
        F.struct(
            "total_ticket_count", "total_handling_hours", "overall_escalation_rate"
        ).alias("audit_summary"),
    )
    described = companies.select(F.col("id").alias("company_id"), F.struct(*companies.columns).alias("company"))
    return (
        described.join(summary, "company_id")
        .join(categories, "company_id")
        .withColumn("scoring_methodology", methodology())
    )


def evidence_packages(per_company: DataFrame, documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON package per process document: ``(*keys, company_id, package)``.

    ``documents`` carries ``company_id`` and ``text``. The company side has one row
    per company and is joined by size: broadcast while small, else a shuffle join
    whose oversized partitions are split.
    """
    parts = F.struct(
        "company",
        "audit_summary",
        "categories",
        "scoring_methodology",
        F.col("text").alias("process_documentation"),
    )
    return documents.join(per_company, "company_id").select(
        *keys, "company_id", F.to_json(parts, {"ignoreNullFields": "false"}).alias("package")
    )


def raw_row_mentions(packages: DataFrame, keys: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """For each package, which raw-ticket markers (column names, id prefixes) occur in it."""
    found = F.array_compact(
        F.array(*(F.when(F.col("package").contains(m), F.lit(m)) for m in markers))
    )
    return packages.select(
        *keys,
        "company_id",
        F.size(found).alias("markers_found"),
        (F.size(found) == 0).alias("row_free"),
    )


def _grams(text: Column, size: int, letters: str = ".") -> Column:
    """All runs of ``size`` letters of a text that begin with one of ``letters`` (the inside of a regular expression's class)."""
    first = letters if letters == "." else f"[{letters}]"
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({first}.{{{size - 1}}}))"), F.lit(1))


def _text_grams(texts: DataFrame, keys: Sequence[str], column: str, letters: Mapping[int, str]) -> DataFrame:
    """``(*keys, _gram)``: each gram of the given sizes and first letters once per text."""
    found = [_grams(F.col(column), size, first) for size, first in sorted(letters.items())]
    # Outer, as a filter on the number of grams would be pushed into the scan and cut each text twice.
    return texts.select(*keys, F.explode_outer(F.array_distinct(F.concat(*found))).alias("_gram"))


def rarest_grams(needles: DataFrame, texts: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One gram by which each needle is looked up: ``(needle, _gram)``.

    A needle has the runs of ``GRAM`` letters (a shorter one itself). What looking one up costs is the number of texts that hold it,
    counted over one in ``SAMPLED`` texts, times the number of needles that hold it; the cheapest is taken, of equally cheap
    ones the first in the needle. The sample steers only the effort: whatever gram is taken, no needle is missed.
    """
    size = F.least(F.length("needle"), F.lit(GRAM))
    parts = needles.select("needle", F.posexplode(_grams(F.col("needle"), GRAM)).alias("_at", "_gram"))
    short = needles.filter(size < GRAM).select("needle", F.lit(0).alias("_at"), F.col("needle").alias("_gram"))
    parts = parts.unionByName(short).groupBy("needle", "_gram").agg(F.min("_at").alias("_at"))
    held = parts.groupBy("_gram").agg(F.count("*").alias("_needles"))
    sample = texts.filter(F.pmod(F.xxhash64(*keys), F.lit(SAMPLED)) == 0)
    sizes = {r["size"]: "." for r in needles.select(size.alias("size")).distinct().collect()} or {GRAM: "."}
    seen = _text_grams(sample, keys, column, sizes).groupBy("_gram").agg(F.count("*").alias("_texts"))
    cost = (F.coalesce("_texts", F.lit(0)) + 1) * F.col("_needles")
    priced = parts.join(held, "_gram").join(seen, "_gram", "left")
    return priced.groupBy("needle").agg(F.min(F.struct(cost.alias("cost"), "_at", "_gram")).alias("best")).select("needle", "best._gram")


def mentions(texts: DataFrame, keys: Sequence[str], column: str, needles: DataFrame) -> DataFrame:
    """Which needles occur in which texts, as substrings: ``(*keys, needle)``.

    Each needle is looked up by its rarest gram. Texts give only grams that begin with a letter with which such a gram begins, each once; every
    match is a candidate, one a row, and texts come back to be searched for their candidates alone. One way for any number
    of needles; null and empty ones and null texts mention nothing. ``keys`` identify a text.
    """
    known = needles.select(F.col(needles.columns[0]).alias("needle")).filter("needle <> ''").distinct()
    index = staged(rarest_grams(staged(known, "needles"), texts, keys, column), "rarest-grams")
    letters: dict[int, str] = {}
    for size, first in index.select(F.length("_gram"), F.ascii("_gram")).distinct().orderBy(F.col("length(_gram)"), F.col("ascii(_gram)")).collect():
        letters[size] = letters.get(size, "") + f"\\x{{{first:x}}}"
    if not letters:
        return texts.select(*keys, F.col(column).alias("needle")).limit(0)
    near = staged(_text_grams(texts, keys, column, letters).join(index, "_gram").select(*keys, "needle"), "candidates")
    return (
        texts.select(*keys, F.col(column).alias("_text"))
        .join(near, list(keys))
        .filter(F.contains("_text", F.col("needle")))
        .select(*keys, "needle")
    )


def foreign_mentions(documents: DataFrame, keys: Sequence[str], company_ids: DataFrame) -> DataFrame:
    """Documents in which another company's id occurs as a substring.

    The company's own part of a package is one row per company and is checked by the same function.
    """
    found = mentions(documents, [*keys, "company_id"], "text", company_ids)
    return found.filter(F.col("needle") != F.col("company_id")).withColumnRenamed("needle", "foreign_id")


def quoted_tickets(documents: DataFrame, keys: Sequence[str], descriptions: DataFrame) -> DataFrame:
    """Texts of tickets that occur in documents: ``(*keys, description)``."""
    return mentions(documents, keys, "text", descriptions).withColumnRenamed("needle", "description")


def checksums(packages: DataFrame, keys: Sequence[str]) -> DataFrame:
    return packages.select(*keys, F.sha2("package", 256).alias("checksum"))


def changed_evidence(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose package differs between two states, or is in only one of them."""
    left = checksums(before, keys).withColumnRenamed("checksum", "before")
    right = checksums(after, keys).withColumnRenamed("checksum", "after")
    return left.join(right, list(keys), "full_outer").filter(
        ~F.col("before").eqNullSafe(F.col("after"))
    )
