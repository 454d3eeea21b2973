"""Ticket tables in delimited text."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.errors import DataContractError
from ticketlens.fixed_values import TICKET_COLUMNS

CORRUPT = "_unreadable"
DIALECT = {"header": True, "quote": '"', "escape": '"'}
# The writer's partition column that says whether a file's cells may hold line breaks.
LINE_BREAKS = "ticket_line_breaks"
# A multi-line file is read by one task, so the writer keeps files moderate.
ROWS_PER_FILE = 1_000_000


def missing_columns(columns) -> list[str]:
    return sorted(set(TICKET_COLUMNS) - set(columns))


def _header(spark: SparkSession, path: str, multi_line: bool) -> tuple[str, ...]:
    try:
        columns = spark.read.options(**DIALECT, multiLine=multi_line).csv(path).columns
    except Exception as error:
        raise DataContractError(f"Unable to load support tickets: {path}") from error
    if not columns:
        raise DataContractError(f"Unable to load support tickets: {path}")
    return tuple(columns)


def tickets_of(spark: SparkSession, path: str, companies: DataFrame) -> DataFrame:
    """Tickets, stored as Parquet by ``company_id``, of the companies in ``companies`` (``company_id``, each once or more).

    A filter on any column of the registry prunes the files read, once the registry is known at run time.
    """
    store = spark.read.parquet(path)
    return store.join(companies.select("company_id"), "company_id", "left_semi")


def read_ticket_files(
    spark: SparkSession, paths: Mapping[str, str], *, multi_line: bool
) -> DataFrame:
    """A few companies' ticket files as text columns, one scan per company.

    ``paths`` maps company ids to files or folders. Columns are taken by name, so
    files may order them differently or carry more; further columns are dropped.
    A row that does not fit its header has its text in the ``_unreadable`` column.
    For many companies use one folder and :func:`read_ticket_folder`, which also says what
    ``multi_line`` costs.
    """
    scans = []
    for company_id, path in paths.items():
        header = _header(spark, path, multi_line)
        missing = missing_columns(header)
        if missing:
            raise DataContractError(f"Missing required ticket columns: {', '.join(missing)}")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, CORRUPT)])
        scans.append(
            spark.read.options(
                **DIALECT, multiLine=multi_line, columnNameOfCorruptRecord=CORRUPT
            )
            .schema(schema)
            .csv(path)
            .select(F.lit(company_id).alias("company_id"), *TICKET_COLUMNS, CORRUPT)
        )
    return reduce(DataFrame.unionByName, scans)


def read_ticket_folder(spark: SparkSession, path: str, *, multi_line: bool | None = None) -> DataFrame:
    """A folder written by :func:`write_ticket_files`, as text columns.

    For files that may differ or be broken see :func:`ticketlens.sources.folders.read_folder_apart`.

    ``multi_line`` allows line breaks inside cells, and then a file is read by one task, however large it is; without it
    files are split. By default that follows the folder: files that the writer recorded as free of breaks are split, all
    others are read whole. A folder whose header lacks a column breaks the contract.
    """
    header = _header(spark, path, multi_line is not False)
    missing = missing_columns(header)
    if missing:
        raise DataContractError(f"Missing required ticket columns: {', '.join(missing)}")
    recorded = LINE_BREAKS in header
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*TICKET_COLUMNS, CORRUPT)])
    for partition in ("company_id", *([LINE_BREAKS] if recorded else [])):
        schema = schema.add(partition, T.StringType())

    def scan(whole_files: bool) -> DataFrame:
        options = {**DIALECT, "multiLine": whole_files, "columnNameOfCorruptRecord": CORRUPT, "enforceSchema": False}
        return spark.read.options(**options).schema(schema).csv(path)

    if multi_line is None and recorded:
        # Filters on a partition column: each scan lists the folder and reads its own files only.
        free = F.col(LINE_BREAKS).eqNullSafe("false")
        rows = scan(False).filter(free).unionByName(scan(True).filter(~free))
    else:
        rows = scan(multi_line is not False)
    return rows.select("company_id", *TICKET_COLUMNS, CORRUPT)


def write_ticket_files(tickets: DataFrame, path: str) -> None:
    """Write one folder per company with a header and a stable column order.

    Within it, rows with a line break in a cell have files of their own, so that the others can be split when read.
    """
    written = tickets.select(
        "company_id",
        *(
            F.date_format(
                F.to_utc_timestamp("created_at", F.current_timezone()),
                "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
            ).alias(name)
            if name == "created_at" and isinstance(tickets.schema[name].dataType, T.TimestampType)
            else F.col(name)
            for name in TICKET_COLUMNS
        ),
    )
    broken = reduce(lambda a, b: a | b, (F.coalesce(F.col(c).cast("string").rlike("[\r\n]"), F.lit(False)) for c in TICKET_COLUMNS))
    (
        written.withColumn(LINE_BREAKS, broken)
        .write.mode("overwrite")
        .partitionBy("company_id", LINE_BREAKS)
        .options(
            header=True,
            quote='"',
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
            maxRecordsPerFile=ROWS_PER_FILE,
        )
        .csv(path)
    )
