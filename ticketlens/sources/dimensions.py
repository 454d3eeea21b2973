"""Small lookup tables given as Python values."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ticketlens.errors import DataContractError
from ticketlens.fixed_values import PROCESS_FACTORS
from ticketlens.sources.schemas import FACTORS


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A table whose size the planner knows.

    Arrow data becomes a local relation, so joins with it, and with what is computed
    from it, are broadcast by their size; a list of rows would count as unbounded.
    """
    columns = {f.name: [row[i] for row in rows] for i, f in enumerate(schema)}
    return spark.createDataFrame(pa.table(columns), schema)


def factor_table(spark: SparkSession, rows: Sequence[tuple] = PROCESS_FACTORS) -> DataFrame:
    """Category factors, one row per category; its categories are the category domain."""
    names = [row[0] for row in rows]
    if len(set(names)) != len(names):
        raise DataContractError("A category has more than one row of factors")
    return literal_table(spark, rows, FACTORS)
