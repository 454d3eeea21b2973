"""Hash trees over the parts of evidence: what changed between two states, and where, without comparing what didn't.

A tree has a root, parts below it and named children below each part; a node's hash is that of its children's names and hashes. Only
hashes are kept. Two states are compared from the root down: equal roots end there, equal parts aren't opened.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHILDREN = "array<struct<name:string,hash:string>>"


def _node(children: Column) -> Column:
    return F.md5(F.array_join(F.transform(children, lambda c: F.concat_ws("=", c["name"], c["hash"])), "\n"))


def leaf(name: Column, text: Column) -> Column:
    """One child; a null text differs from any text."""
    return F.struct(name.alias("name"), F.coalesce(F.md5(text), F.lit("null")).alias("hash"))


def lines(text: Column) -> Column:
    """A child for every line, named by its number; a null text has none."""
    parts = F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))
    return F.transform(parts, lambda line, i: leaf(F.concat(F.lit("line "), i), line))


def parts(children: Mapping[str, Column]) -> Column:
    """The parts of a tree: name, hash and children of each; names of children don't repeat within a part."""
    named = F.array(*(F.struct(F.lit(name).alias("part"), c.cast(_CHILDREN).alias("children")) for name, c in children.items()))
    return F.transform(named, lambda p: F.struct(p["part"].alias("part"), _node(p["children"]).alias("hash"), p["children"].alias("children")))


def root(found: Column) -> Column:
    return F.md5(F.array_join(F.transform(found, lambda p: F.concat_ws("=", p["part"], p["hash"])), "\n"))


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, part, name, change)``: children that were changed, added or removed.

    Both sides hold ``keys``, ``root`` and ``parts`` of the same names, one row per key. A key in one state only has all its children added or
    removed. Trees with equal roots leave at the join; of the others only parts with different hashes are opened.
    """
    old = before.select(*keys, F.col("root").alias("_old_root"), F.col("parts").alias("_old"))
    new = after.select(*keys, F.col("root").alias("_new_root"), F.col("parts").alias("_new"))
    both = old.join(new, list(keys), "full_outer").filter(~F.col("_old_root").eqNullSafe(F.col("_new_root")))
    nothing = F.array().cast(f"array<struct<part:string,hash:string,children:{_CHILDREN}>>")

    def opened(own: str, other: str) -> DataFrame:
        apart = F.filter(F.coalesce(own, nothing), lambda p: ~F.exists(F.coalesce(other, nothing), lambda q: (q["part"] == p["part"]) & (q["hash"] == p["hash"])))
        found = both.select(*keys, F.inline(F.transform(apart, lambda p: F.struct(p["part"].alias("part"), p["children"].alias("children")))))
        return found.select(*keys, "part", F.inline("children")).withColumn("_old_side", F.lit(own == "_old"))

    sides = opened("_old", "_new").unionByName(opened("_new", "_old"))
    was, now = F.max(F.when(F.col("_old_side"), F.col("hash"))), F.max(F.when(~F.col("_old_side"), F.col("hash")))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    found = sides.groupBy(*keys, "part", "name").agg(was.alias("was"), now.alias("now")).withColumn("change", change)
    return found.filter("change IS NOT NULL").select(*keys, "part", "name", "change")
