"""The ticket contract: row violations, duplicate keys, a report and a gate.

Input is the text form of the tickets (``company_id`` plus the eight columns as
strings). A cell that cannot be read is a finding, never a silent null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.errors import DataContractError
from ticketlens.fixed_values import FALSE_WORDS, NULL_MARKERS, TICKET_COLUMNS, TRUE_WORDS
from ticketlens.sources.tickets import CORRUPT

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([Tt _]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s?([Zz]|[+-]\d{2}:?\d{2})?)?$"
)
_USUAL = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?"
_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
_PLAIN_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_NUMBER = rf"{_PLAIN_NUMBER}|^(?i)[+-]?inf(inity)?$"
# Epoch numbers above this many seconds are read as milliseconds.
_SECONDS_BOUND = 2e10

_TEXT_COLUMNS = ("ticket_id", "category", "description", "channel", "customer_tier")


def is_missing(x: Column) -> Column:
    return x.isNull() | x.isin(*NULL_MARKERS)


def parse_minutes(x: Column) -> Column:
    trimmed = F.trim(x)
    return F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))


def parse_flag(x: Column) -> Column:
    word = F.lower(x)
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(
        word.isin(*FALSE_WORDS), F.lit(False)
    )


def parse_time(x: Column) -> Column:
    """ISO text or an epoch number; a time without an offset is taken as UTC."""
    seconds = x.try_cast("double")
    micros = F.when(F.abs(seconds) > _SECONDS_BOUND, seconds * 1e3).otherwise(seconds * 1e6)
    # The cast wants seconds wherever an offset follows, and no space before it.
    iso = F.regexp_replace(F.translate(x, "tz_,", "TZT."), r"\s(?=Z$|[+-]\d{2}:?\d{2}$)", "")
    iso = F.regexp_replace(iso, rf"([T ]\d{{2}}:\d{{2}})(?={_OFFSET}|$)", "$1:00")
    zoned = (
        F.when(F.length(x) == 10, F.concat(x, F.lit("T00:00:00Z")))
        .when(iso.rlike(_OFFSET), iso)
        .otherwise(F.concat(iso, F.lit("Z")))
    )
    # The two usual forms need no rewriting.
    return (
        F.when(x.rlike(_USUAL + _OFFSET), x.try_cast("timestamp"))
        .when(x.rlike(_USUAL + "$"), F.concat(x, F.lit("Z")).try_cast("timestamp"))
        .when(x.rlike(_ISO), zoned.try_cast("timestamp"))
        .when(x.rlike(_PLAIN_NUMBER), F.timestamp_micros(micros.try_cast("bigint")))
    )


def with_violations(raw: DataFrame, categories: DataFrame) -> DataFrame:
    """Add the parsed columns and an array of violations to each raw row.

    ``categories`` is the category domain, one row per category; a left join flags values outside it, so
    no row is lost.
    """
    domain = categories.select("category", F.lit(True).alias("_known"))
    # Parsed cells and violations leave a generator, below which no later filter is pushed: each
    # cell is parsed once, whatever is asked of it.
    cells = F.struct(
        parse_minutes(F.col("resolution_minutes")).alias("_minutes"),
        parse_flag(F.col("escalated")).alias("_flag"),
        parse_time(F.col("created_at")).alias("_time"),
    )
    parsed = raw.join(domain, "category", "left").select("*", F.inline(F.array(cells)))
    missing = {name: is_missing(F.col(name)) for name in TICKET_COLUMNS}

    def finding(name: str, broken: Column, what: str) -> Column:
        return F.when(~missing[name] & broken, F.lit(f"{name}: {what}"))

    findings = [F.when(missing[name], F.lit(f"{name}: missing")) for name in TICKET_COLUMNS] + [
        finding("created_at", F.col("_time").isNull(), "not a time"),
        finding("category", F.col("_known").isNull(), "outside domain"),
        finding("resolution_minutes", F.col("_minutes").isNull(), "not a number"),
        finding("resolution_minutes", F.col("_minutes") < 0, "negative"),
        finding("escalated", F.col("_flag").isNull(), "not a flag"),
    ]
    if CORRUPT in raw.columns:
        findings.insert(0, F.when(F.col(CORRUPT).isNotNull(), F.lit("row: unreadable")))
    found = F.array_compact(F.array(*findings))
    return parsed.select("*", F.explode(F.array(found)).alias("violations")).drop("_known")


def normalized(checked: DataFrame) -> DataFrame:
    """Rows without violations, typed, in the fixed column order."""
    return checked.filter(F.size("violations") == 0).select(
        "company_id",
        "ticket_id",
        F.col("_time").alias("created_at"),
        "category",
        "description",
        F.col("_minutes").alias("resolution_minutes"),
        F.col("_flag").alias("escalated"),
        "channel",
        "customer_tier",
    )


def quarantine(checked: DataFrame) -> DataFrame:
    """Rows with violations, as read."""
    return checked.filter(F.size("violations") > 0).drop("_time", "_minutes", "_flag")


def duplicate_keys(raw: DataFrame) -> DataFrame:
    """Ticket ids that occur more than once in a company, with their counts.

    Only the two key columns are read and shuffled, after counting per partition,
    so one id held by very many rows costs no more than any other.
    """
    return (
        raw.groupBy("company_id", "ticket_id")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter((F.col("occurrences") > 1) & ~is_missing(F.col("ticket_id")))
    )


def unknown_categories(raw: DataFrame, categories: DataFrame) -> DataFrame:
    """Category values outside the domain with their row counts, per company."""
    counted = raw.groupBy("company_id", "category").agg(F.count(F.lit(1)).alias("rows"))
    return counted.filter(~is_missing(F.col("category"))).join(
        categories.select("category"), "category", "left_anti"
    )


# The order in which a failing check stops a run.
CHECKS = (
    (1, "unreadable"),
    (2, "empty"),
    (3, "missing values"),
    (4, "duplicate ticket_id"),
    (5, "invalid rows"),
    (6, "numeric text column"),
)

MESSAGES = {
    "unreadable": "Unable to load support tickets",
    "empty": "Support ticket dataset must not be empty",
    "missing values": "Required ticket fields must not contain null values",
    "duplicate ticket_id": "ticket_id values must be unique",
    "invalid rows": "One or more support tickets are invalid",
    "numeric text column": "One or more support tickets are invalid",
}


# Flags of a row, named apart from the column of unreadable text.
FLAGS = ("_row_unreadable", "_row_missing", "_row_invalid")


def flagged(checked: DataFrame) -> DataFrame:
    """Add what the report counts as flags of each row: ``FLAGS``, and which text columns hold a number."""
    numeric = {
        f"_{name}_numeric": F.coalesce(F.col(name).rlike(_PLAIN_NUMBER), F.lit(False)) for name in _TEXT_COLUMNS
    }
    return checked.withColumns(
        {
            "_row_unreadable": F.array_contains("violations", "row: unreadable"),
            "_row_missing": F.exists("violations", lambda v: v.endswith(": missing")),
            "_row_invalid": F.exists("violations", lambda v: ~v.endswith(": missing") & ~v.startswith("row:")),
            **numeric,
        }
    )


def quality_report(checked: DataFrame, companies: DataFrame) -> DataFrame:
    """Findings per company and check: ``(company_id, check_no, check, findings)``.

    ``companies`` lists the expected company ids, so a company without a single
    row is reported as empty; further companies in the rows are reported too. Rows are read and
    shuffled once, after partial counts by ticket id.
    """
    return report_of(flagged(checked), companies)


def report_of(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """The report from rows that carry their flags, stored ones for instance; of other columns it reads the two ids."""
    # By ticket id first, which finds repeated ids, then by company.
    per_id = rows.groupBy("company_id", "ticket_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        *(F.count_if(name).alias(name) for name in FLAGS),
        *(F.min(f"_{name}_numeric").alias(f"_{name}_numeric") for name in _TEXT_COLUMNS),
    )
    repeated = F.when((F.col("_rows") > 1) & ~is_missing(F.col("ticket_id")), F.col("_rows") - 1)
    counts = per_id.groupBy("company_id").agg(
        F.sum(repeated).alias("_duplicates"),
        *(F.sum(name).alias(name) for name in ("_rows", *FLAGS)),
        *(F.min(f"_{name}_numeric").alias(f"_{name}_numeric") for name in _TEXT_COLUMNS),
    )
    joined = companies.select("company_id").join(counts, "company_id", "full_outer")
    numeric = sum(
        (F.coalesce(F.col(f"_{name}_numeric").cast("int"), F.lit(0)) for name in _TEXT_COLUMNS),
        F.lit(0),
    ).cast("bigint")
    values = {
        "unreadable": F.col("_row_unreadable"),
        "empty": F.when(F.col("_rows").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
        "missing values": F.col("_row_missing"),
        "duplicate ticket_id": F.col("_duplicates"),
        "invalid rows": F.col("_row_invalid"),
        "numeric text column": numeric,
    }
    entries = [
        F.struct(
            F.lit(number).alias("check_no"),
            F.lit(name).alias("check"),
            F.coalesce(values[name], F.lit(0).cast("bigint")).alias("findings"),
        )
        for number, name in CHECKS
    ]
    return joined.select("company_id", F.inline(F.array(*entries)))


def require_valid(report: DataFrame) -> None:
    """Raise on the first check with findings, in check order."""
    first = (
        report.filter(F.col("findings") > 0).orderBy("check_no", "company_id").limit(1).collect()
    )
    if first:
        raise DataContractError(f"{MESSAGES[first[0]['check']]}: {first[0]['company_id']}")
