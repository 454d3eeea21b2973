"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.session import staged


def _with_least(links: DataFrame) -> DataFrame:
    """Each directed link with the least of its start and the start's neighbours."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return links.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _with_least(down)
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(joined.select("u", F.col("m").alias("v")))
        .filter("u != v")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``(u, v)`` links of longs -> ``(node, root)`` for every node that isn't its component's least.

    Self links and repeated links are ignored; nulls must not occur. Each round halves paths
    at least, is two shuffles of the links, and is written to the shared folder, so lost
    executors cost one round. Minima are partially aggregated, and joins back to a node with very many
    links can be split by adaptive execution.
    """
    now = staged(links.select("u", "v").filter("u != v").distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        now = staged(_small_star(_large_star(now)), "links")
