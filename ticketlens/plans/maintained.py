"""A support audit kept up to date: stored sums per ticket file, to which new files are added without reading the old ones.

The state is a folder of two tables. ``cubes`` holds the ticket cube of every file (whole, exact sums, see ``metrics``), ``files`` what
was read: path, time of change and length. Both grow by one partition ``load=…`` per refresh; a load counts once its ``files`` are
written, so one that failed half-way leaves nothing behind that is read.

A changed file is read anew, and a file that is gone no longer counts, as only files that are still listed
as they were read are merged. Sums are whole numbers of units, millionths and trillionths, so the merged audit equals that of all tickets
at once, bit for bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.operators import metrics as me

IDENTITY = ("file", "modified", "length")
_FILES = "file string, modified timestamp, length bigint, load string"
Reader = Callable[[Sequence[str]], DataFrame]


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder, by their metadata alone: ``(file, modified, length, path)``; ``path`` is what readers take."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_size").alias("length"),
        "path",
    )


def _held(spark: SparkSession, state: str) -> DataFrame:
    """What the state has read; the latest load of a file, if several read the same."""
    try:
        files = spark.read.schema(_FILES).parquet(f"{state}/files")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], _FILES)
    return files.groupBy(*IDENTITY).agg(F.max("load").alias("load"))


def stored_tickets(spark: SparkSession, folder: str) -> Reader:
    """Reader of tickets stored as Parquet below ``folder``, with each row's ``file``."""

    def read(paths: Sequence[str]) -> DataFrame:
        rows = spark.read.option("basePath", folder).parquet(*paths)
        return rows.select("*", F.col("_metadata.file_path").alias("file"))

    return read


def unread(spark: SparkSession, state: str, folder: str) -> DataFrame:
    """Files of the folder that the state does not hold as they are now."""
    return listing(spark, folder).join(_held(spark, state), list(IDENTITY), "left_anti")


def file_cubes(tickets: DataFrame, dimensions: Sequence[str] = me.DIMENSIONS) -> DataFrame:
    """The ticket cube of each file of ``tickets``, which carry the path in ``file``."""
    return me.ticket_cube(tickets, ("file", *dimensions))


def refresh(
    spark: SparkSession, state: str, folder: str, read: Reader | None = None, dimensions: Sequence[str] = me.DIMENSIONS
) -> int:
    """Add the files of ``folder`` that ``state`` does not hold, and return how many there were.

    Only they are read. The driver holds their paths, as it does for any scan.
    """
    new = unread(spark, state, folder)
    paths = sorted(r["path"] for r in new.select("path").collect())
    if not paths:
        return 0
    load = uuid.uuid4().hex
    tickets = (read or stored_tickets(spark, folder))(paths)
    file_cubes(tickets, dimensions).write.parquet(f"{state}/cubes/load={load}")
    new.filter(F.col("path").isin(paths)).select(*IDENTITY).write.parquet(f"{state}/files/load={load}")
    return len(paths)


def cube(spark: SparkSession, state: str, folder: str, dimensions: Sequence[str] = me.DIMENSIONS) -> DataFrame:
    """The cube of all files of ``folder``, merged from the state; no ticket is read.

    Files that no refresh has read are not in it.
    """
    valid = listing(spark, folder).drop("path").join(_held(spark, state), list(IDENTITY)).select("file", "load")
    cubes = spark.read.parquet(f"{state}/cubes").join(valid, ["file", "load"], "left_semi")
    return me.merged_cube(cubes, dimensions)
