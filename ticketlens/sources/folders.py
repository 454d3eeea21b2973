"""Folders of ticket files that may differ or be broken: a finding for every file, and the good ones read.

One scan of the files' lines gives each file its header and last line; files without content come from the listing. A file that
breaks a rule is set aside by name, and the others are read, each by its own header.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.fixed_values import TICKET_COLUMNS
from ticketlens.session import staged
from ticketlens.sources.tickets import CORRUPT, DIALECT

OK, EMPTY, UNREADABLE, HEADER, CUT = "ok", "empty", "unreadable", "wrong header", "cut"
_COMPANY = "/company_id=([^/]+)/"


def _one_form(path: Column) -> Column:
    """Paths without a host are written with one slash after the scheme here and with three there."""
    return F.regexp_replace(path, "^([^:/]+):/+", "$1:/")


def _cells(line: Column) -> Column:
    """Names in a header line, without quotes, blanks around them and the mark that some writers put first."""
    bare = F.regexp_replace(line, "^\\x{FEFF}|\\r$", "")
    return F.transform(F.split(bare, ","), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))


def _commas(line: Column) -> Column:
    outside = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(outside) - F.length(F.replace(outside, F.lit(","), F.lit("")))


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def file_findings(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, path, company_id, length, header, lines, verdict, detail)`` of every file below ``folder``.

    The first rule that a file breaks is its verdict: ``empty`` (no byte, or no line beside the header), ``unreadable`` (bytes
    that aren't UTF-8, or zero bytes), ``wrong header`` (a column lacks or occurs twice; ``detail`` names them), ``cut`` (a quote that isn't
    closed, or a last row with fewer cells than the header). Columns may stand in any order, and further ones are
    allowed. Header names hold no comma. ``company_id`` is the folder's, null without one. Lines are counted, not rows: cells may hold breaks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    sized = files.select(_one_form(F.col("_metadata.file_path")).alias("file"), "path", F.col("_metadata.file_size").alias("length"))
    # Scans leave out files without a byte; the list of input files has them.
    named = spark.createDataFrame([(name,) for name in files.inputFiles()], "file string").select(_one_form(F.col("file")).alias("file"))
    plain = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    listed = named.join(sized, "file", "left").select(
        "file", F.coalesce("path", plain).alias("path"), F.coalesce("length", F.lit(0).cast("long")).alias("length")
    )
    lines = spark.read.option("recursiveFileLookup", True).text(folder)
    lines = lines.select(
        _one_form(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        # Rises within a block, which one task reads in order.
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    filled = F.trim("value") != ""
    place = F.struct("block", "at")
    of_file = lines.groupBy("file").agg(
        F.min_by("value", F.when(filled, place)).alias("first"),
        F.max_by("value", F.when(filled, place)).alias("last"),
        F.count_if(filled).alias("lines"),
        F.count_if(~F.is_valid_utf8("value") | F.contains("value", F.lit("\0"))).alias("odd"),
        F.sum(_quotes(F.col("value"))).alias("quotes"),
    )
    found = listed.join(of_file, "file", "left").withColumn("header", _cells(F.col("first")))
    lacking = F.array_sort(F.array_except(F.array(*(F.lit(c) for c in TICKET_COLUMNS)), "header"))
    twice = F.size("header") > F.size(F.array_distinct("header"))
    short = (_quotes(F.col("last")) % 2 == 0) & (_commas(F.col("last")) < F.size("header") - 1)
    rules = (
        (EMPTY, F.coalesce("lines", F.lit(0)) == 0, F.lit("no content")),
        (UNREADABLE, F.col("odd") > 0, F.lit("not UTF-8 text")),
        (HEADER, F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", "))),
        (HEADER, twice, F.lit("a column occurs twice")),
        (EMPTY, F.col("lines") == 1, F.lit("no rows")),
        (CUT, F.col("quotes") % 2 == 1, F.lit("a quote is not closed")),
        (CUT, short, F.lit("the last row lacks cells")),
    )
    verdict = reduce(lambda rest, rule: F.when(rule[1], F.struct(F.lit(rule[0]).alias("verdict"), rule[2].alias("detail"))).otherwise(rest),
                     reversed(rules), F.struct(F.lit(OK).alias("verdict"), F.lit("").alias("detail")))
    company = F.regexp_extract("path", _COMPANY, 1)
    return found.select(
        "file", "path", F.when(company != "", company).alias("company_id"), "length", "header", F.coalesce("lines", F.lit(0)).alias("lines"),
        verdict.alias("verdict"),
    ).select("file", "path", "company_id", "length", "header", "lines", "verdict.verdict", "verdict.detail")


def read_good_files(spark: SparkSession, folder: str, findings: DataFrame, *, multi_line: bool = True) -> DataFrame:
    """Rows of the files that ``findings`` calls good, as text columns with ``company_id``; one scan for all files of one header.

    The driver holds the paths, as it does for any scan. Without a good file there are no rows.
    """
    good = findings.filter(F.col("verdict") == OK).groupBy("header").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    scans = []
    for row in good.orderBy("header").collect():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*row["header"], CORRUPT)]).add("company_id", T.StringType())
        scan = spark.read.options(**DIALECT, multiLine=multi_line, columnNameOfCorruptRecord=CORRUPT, basePath=folder)
        scans.append(scan.schema(schema).csv(row["paths"]).select("company_id", *TICKET_COLUMNS, CORRUPT))
    if not scans:
        names = ("company_id", *TICKET_COLUMNS, CORRUPT)
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in names))
    return reduce(DataFrame.unionByName, scans)


def read_folder_apart(spark: SparkSession, folder: str, *, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of the good files, and the findings of all files, stored."""
    findings = staged(file_findings(spark, folder), "file-findings")
    return read_good_files(spark, folder, findings, multi_line=multi_line), findings
