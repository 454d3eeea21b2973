"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable
from types import ModuleType
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space as all word rules of this package read it.
SPACES = "[\\x20\\x09-\\x0D]+"
# Rows of a narrow id table up to which it is broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 1_000_000


Made = TypeVar("Made")


def once(key: Hashable, make: Callable[[], Made]) -> Made:
    """What ``make`` returns, made once per Python process, so also once per worker for all its tasks.

    The store is a module of its own because code that travels by value brings its globals anew with each task.
    """
    store = sys.modules.setdefault("worker_store_of_llm", ModuleType("worker_store_of_llm")).__dict__
    held = store.setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Bound batches that go to Python workers by bytes, unless the session does; the setting stays with the session."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(limit))


def by_rows(narrow: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table marked for broadcast if its counted rows allow it, else as it is.

    Only for stored tables of a few numbers a row, whose count costs no recomputation.
    """
    return F.broadcast(narrow) if narrow.count() <= limit else narrow


def crc_fold(doc_id: Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
