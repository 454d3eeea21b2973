"""Company metadata and the registry of companies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.errors import DataContractError
from ticketlens.fixed_values import DEFAULT_DEMO_STATUS, DEFAULT_TICKET_COUNT
from ticketlens.sources.schemas import COMPANY

REQUIRED = tuple(
    name for name in COMPANY.fieldNames() if name not in ("ticket_count", "demo_status")
)


def read_companies(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Company files, one JSON object per file."""
    return (
        spark.read.schema(COMPANY)
        .options(multiLine=True, dateFormat="yyyy-MM-dd", mode="PERMISSIVE")
        .json(paths)
        .select(*COMPANY.fieldNames())
    )


def write_companies(companies: DataFrame, path: str) -> None:
    """One JSON object per file, in one folder per company."""
    (
        companies.select(
            F.col("id").alias("company"),
            F.to_json(F.struct(*COMPANY.fieldNames())).alias("value"),
        )
        .write.mode("overwrite")
        .partitionBy("company")
        .text(path)
    )


def apply_company_contract(companies: DataFrame) -> DataFrame:
    """Fill the two defaults and list each row's violations."""
    filled = companies.withColumns(
        {
            "ticket_count": F.coalesce("ticket_count", F.lit(DEFAULT_TICKET_COUNT).cast("bigint")),
            "demo_status": F.coalesce("demo_status", F.lit(DEFAULT_DEMO_STATUS)),
        }
    )
    findings = [
        F.when(F.col(name).isNull(), F.lit(f"{name} missing")) for name in REQUIRED
    ] + [
        F.when(F.col(name) <= 0, F.lit(f"{name} not positive"))
        for name in ("support_team_size", "ticket_count")
    ]
    return filled.withColumn("violations", F.array_compact(F.array(*findings)))


def require_valid_companies(checked: DataFrame) -> DataFrame:
    bad = checked.filter(F.size("violations") > 0).select("id").head()
    if bad is not None:
        raise DataContractError(f"Invalid company metadata: {bad['id']}")
    return checked.drop("violations")


def unknown_companies(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested company ids that the registry does not hold, with their row counts."""
    counted = requests.groupBy("company_id").agg(F.count(F.lit(1)).alias("requests"))
    return counted.join(registry.select("company_id"), "company_id", "left_anti")


def resolve_companies(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows of the requested ids; an unknown id raises."""
    unknown = unknown_companies(requests, registry).head()
    if unknown is not None:
        raise DataContractError(f"Unknown company: {unknown['company_id']}")
    return registry.join(requests.select("company_id").distinct(), "company_id", "left_semi")
