"""Process documents: whole-text reading and splitting into sections and bullets.

Splitting works inside each row (array functions and ``posexplode``), so no
document is shuffled and a company with many documents is no hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.errors import DataContractError
from ticketlens.fixed_values import BULLET_START, CATALOG_PROCESS
from ticketlens.functions.text import LINE_BREAK, lines, strip

_REST = 2**31 - 1
# Folders among which documents written one a file are dealt, so that folders are listed and files written by many tasks.
FOLDERS = 256
_LABEL = r"^- \*\*(.+?):\*\*\s*(.*)$"


def read_documents(spark: SparkSession, paths: str | Sequence[str], *, nested: bool = False) -> DataFrame:
    """Whole files as ``(path, text)``, stripped; with ``nested``, those of all folders below.

    Folders below are listed by as many tasks as the path has subfolders, and their names aren't taken for partition columns.
    """
    return spark.read.text(paths, wholetext=True, recursiveFileLookup=nested).select(
        F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("text")
    )


def write_documents(documents: DataFrame, path: str, key: str) -> None:
    """One file for each key, as ``<path>/group=…/<key>=…/part-….txt``; ``path`` is a fresh folder.

    Files cost far more than bytes, so keys are dealt to many tasks, and each task renames its own files when it ends;
    by default the driver would rename them all, one after another.
    """
    group = F.pmod(F.xxhash64(key), F.lit(FOLDERS))
    rows = documents.select(group.alias("group"), key, "text").repartition(FOLDERS, "group")
    rows.write.partitionBy("group", key).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def stripped_documents(documents: DataFrame) -> DataFrame:
    return documents.withColumn("text", strip(F.col("text"))).withColumn(
        "is_empty", F.length("text") == 0
    )


def require_documents(documents: DataFrame, key: str = "path") -> DataFrame:
    empty = documents.filter(F.length("text") == 0).select(key).head()
    if empty is not None:
        raise DataContractError(f"Support process is empty: {empty[key]}")
    return documents


def bullet_lines(text: Column) -> Column:
    """Catalog lines of the labelled bullets, as an array in document order."""
    bullets = F.filter(lines(text), lambda line: line.startswith(BULLET_START))
    return F.transform(bullets, lambda line: F.concat(F.lit(CATALOG_PROCESS), F.substring(line, 3, _REST)))


def process_bullets(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per labelled bullet: ``(*keys, line_no, line)``; ``line_no`` counts lines."""
    return (
        documents.select(*keys, F.posexplode(lines(F.col("text"))).alias("line_no", "raw"))
        .filter(F.col("raw").startswith(BULLET_START))
        .select(
            *keys,
            "line_no",
            F.concat(F.lit(CATALOG_PROCESS), F.substring("raw", 3, _REST)).alias("line"),
        )
    )


def process_sections(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labelled bullets with the second-level heading they stand under.

    The text is first cut before each heading line, so a bullet finds its heading
    in its own piece and no window over the document is needed.
    """
    pieces = F.split("text", rf"(?:{LINE_BREAK})(?=## )")
    return (
        documents.select(*keys, F.posexplode(pieces).alias("section_no", "piece"))
        .filter(F.col("piece").startswith("## "))
        .select(
            *keys,
            "section_no",
            F.lower(strip(F.regexp_extract("piece", r"\A## (.*)", 1))).alias("section"),
            F.posexplode(lines(F.col("piece"))).alias("pos", "raw"),
        )
        .filter(F.col("raw").rlike(_LABEL))
        .select(
            *keys,
            "section_no",
            "pos",
            "section",
            F.regexp_extract("raw", _LABEL, 1).alias("label"),
            F.regexp_extract("raw", _LABEL, 2).alias("text"),
        )
    )
