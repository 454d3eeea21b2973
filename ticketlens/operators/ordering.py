"""Positions in an order, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.session import staged


def numbered(frame: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the place of each row among those with the same ``keys``, from 1, by ``order``.

    Rows are range-sorted and counted per sort partition; a row's position is its place in the
    partition plus the rows of its keys before. A key with most of the rows spreads over partitions.
    ``order`` should tell rows apart.
    """
    columns = [*map(F.col, keys), *order]
    placed = staged(
        frame.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("_place", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright("_place", 33).alias("_part")
    # One row for each sort partition and key in it.
    blocks = placed.groupBy(*keys, part).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1
    blocks = blocks.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part"), shift.alias("_shift"))
    same = F.shiftright("_place", 33) == F.col("_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return placed.join(blocks, same).select(
        *frame.columns, (F.col("_place") + F.col("_shift")).cast("int").alias(name)
    )
