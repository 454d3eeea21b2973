"""Shards by jump consistent hashing, with a gapless slot for every row of a shard.

A key's shard follows from the key and the number of shards alone: a generator seeded with the key
jumps from bucket to bucket, and the last jump below the number of shards is the shard. There
is no ring or table to keep, and with one more shard a row either stays or moves to the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import let
from ticketlens.session import staged

# Multiplier of the generator that jump consistent hashing is defined with, modulo 2^64.
MULTIPLIER = 2862933555777941757
_LOW = (1 << 32) - 1


def _times(half: Column, factor: int) -> Column:
    """A 32-bit number times a 32-bit constant, modulo 2^32, without leaving 63 bits."""
    upper, lower = F.shiftright(half, 16), half.bitwiseAND(F.lit(0xFFFF))
    return (lower * factor + F.shiftleft((upper * factor).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW))


def _next(state: Column) -> Column:
    """``high`` and ``low`` 32-bit halves of state * MULTIPLIER + 1 modulo 2^64."""
    high, low = state["high"], state["low"]
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & _LOW
    first = low.bitwiseAND(F.lit(0xFFFF)) * m_low
    second = F.shiftright(low, 16) * m_low
    bottom = first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    carry = F.shiftright(bottom, 32) + F.shiftright(second, 16)
    return F.struct(
        (_times(high, m_low) + _times(low, m_high) + carry).bitwiseAND(F.lit(_LOW)).alias("high"),
        bottom.bitwiseAND(F.lit(_LOW)).alias("low"),
    )


def jumps(key: Column, shards: int) -> Column:
    """Shard of a long key among ``shards``, and among one more, as a struct ``shard, grown``."""

    def step(state: Column, _: Column) -> Column:
        # A jump at or beyond shards + 1 ends the walk; what follows is left as it is.
        def jump(generator: Column) -> Column:
            stride = F.lit(float(1 << 31)) / (F.shiftright(generator["high"], 1) + 1).cast("double")
            to = F.floor((state["at"] + 1).cast("double") * stride)
            return F.struct(
                generator["high"].alias("high"),
                generator["low"].alias("low"),
                to.alias("at"),
                F.when(to < shards, to).otherwise(state["shard"]).alias("shard"),
                F.when(to < shards + 1, to).otherwise(state["grown"]).alias("grown"),
            )

        return F.when(state["at"] > shards, state).otherwise(let(_next(state), jump))

    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(_LOW)).alias("low"),
        zero.alias("at"),
        zero.alias("shard"),
        zero.alias("grown"),
    )
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(shards)),
        start,
        step,
        lambda state: F.struct(state["shard"].cast("int").alias("shard"), state["grown"].cast("int").alias("grown")),
    )


def key_of(key: Column, kind: str) -> Column:
    """Whole numbers hash as they are, other keys by their text; null hashes as 0."""
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(key.cast("long") if whole else F.xxhash64(key.cast("string")), F.lit(0).cast("long"))


def sharded(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, shard, slot, grown_shard`` for every row.

    ``size`` is the text's UTF-8 bytes plus one (null: one), ``slot`` counts a shard's rows from 0 by key (nulls first), checksum
    and size. Rows that agree in all of them get neighbouring slots. ``grown_shard`` is the shard
    among one more.

    Slots come from a range sort of narrow rows and the row counts of its partitions. A tie-breaker that
    differs for each row lets the sort split a key that repeats very often. An empty table gives an empty one.
    """
    narrow = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        jumps(key_of(F.col(key), dict(docs.dtypes)[key]), shards).alias("at"),
        F.monotonically_increasing_id().alias("tie"),
    )
    narrow = staged(narrow.select("key", "size", "text_crc32", "at.shard", "at.grown", "tie"), "keyed")
    order = ["shard", F.col("key").asc_nulls_first(), "text_crc32", "size", "tie"]
    placed = (
        narrow.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
        .select(
            "key",
            "size",
            "text_crc32",
            "shard",
            "grown",
            F.shiftright("place", 33).alias("part"),
            F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("index"),
        )
    )
    placed = staged(placed, "placed")
    # Few rows: one for each sort partition and shard in it.
    blocks = placed.groupBy("shard", "part").agg(F.min("index").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")
    return placed.join(blocks.select("shard", "part", shift.alias("shift")), ["shard", "part"]).select(
        "key", "size", "text_crc32", "shard", (F.col("index") + F.col("shift")).alias("slot"), F.col("grown").alias("grown_shard")
    )
