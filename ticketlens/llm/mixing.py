"""Mixing sources to target weights over a tree of domains, languages and sources.

A budget of tokens is handed down from the root. A node shares its budget among its children by
weight; a child whose leaves hold less than its share (counting every epoch allowed) takes what it has, and its siblings share
the shortage by weight. As a node never gets more than its leaves hold, a shortage leaves a
family only when the whole family is exhausted, and then falls to the parent's siblings.

A leaf fills its budget with whole epochs and a prefix of one more, whose order is drawn anew
from the seed for every epoch: the documents that begin before the budget ends. Documents that
share an id stand and fall together. A document costs its words plus one.

All of it is DataFrame work. The only groups that are walked in order are siblings, the buckets of a leaf's
histogram, and the ids within the one bucket where a leaf's prefix ends.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import by_rows, words
from ticketlens.session import staged

LEVELS = ("domain", "lang", "source")
SEED = 20_240
EPOCHS = 4  # a document is taken so often at most
BUCKET_DIGITS = 4  # hexadecimal digits of a document's draw that name its bucket
_WIDE = "decimal(38,0)"


def tokens(text: Column) -> Column:
    """Cost of a text: its words, and one for its end."""
    return (F.size(words(text)) + 1).cast("long")


def weight(default: int, given: Mapping[str, int], name: Column) -> Column:
    """A whole-number weight by name, ``default`` for names not listed."""
    out = F.lit(default)
    for key, value in given.items():
        out = F.when(name == key, value).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, family: list[str], name: str) -> DataFrame:
    """Column ``budget`` of siblings that share ``given`` by ``weight``, none beyond its ``capacity``.

    Filled by rising capacity per weight: a node is full if its family could be raised to its level without
    using up what is given. The others share the rest by weight; whole tokens left over go to
    the largest fractions, then by name.
    """
    every = Window.partitionBy(*family)
    order = every.orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), name)
    below = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(_WIDE))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = below * F.col("weight") + F.col("capacity") * weights
    now = nodes.filter("weight > 0").withColumns({c: F.col(c).cast(_WIDE) for c in ("capacity", "weight", "given")})
    now = now.withColumn("full", level <= F.col("given") * F.col("weight"))
    now = now.withColumns(
        {
            "rest": F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(every), F.lit(0).cast(_WIDE)),
            "open": F.sum(F.when(~F.col("full"), F.col("weight"))).over(every),
        }
    )
    now = now.withColumns(
        {
            "part": F.expr(f"CASE WHEN full THEN capacity ELSE CAST(rest * weight DIV open AS {_WIDE}) END"),
            "fraction": F.expr(f"CASE WHEN full THEN CAST(-1 AS {_WIDE}) ELSE rest * weight % open END"),
        }
    )
    now = now.withColumns(
        {
            "left": F.col("rest") - F.coalesce(F.sum(F.when(~F.col("full"), F.col("part"))).over(every), F.lit(0).cast(_WIDE)),
            "place": F.row_number().over(every.orderBy(F.col("fraction").desc(), name)),
        }
    )
    extra = F.when(~F.col("full") & (F.col("place") <= F.col("left")), 1).otherwise(0)
    return now.withColumn("budget", (F.col("part") + extra).cast("long"))


def leaf_key() -> Column:
    """One text that names a leaf; nulls are names of their own."""
    return F.to_json(F.struct(*LEVELS), {"ignoreNullFields": "false"})


def budgets(leaves: DataFrame, total: int | None = None, epochs: int = EPOCHS) -> DataFrame:
    """``leaf, tokens, capacity, budget`` of leaves given as
    ``domain, lang, source, weight_domain, weight_lang, weight_source, tokens``.

    ``total`` defaults to the tokens of all leaves, and is cut to what the leaves with weight hold in
    ``epochs`` epochs. Leaves below a node of weight 0 have neither capacity nor budget.
    """
    weighted = " AND ".join(f"weight_{level} > 0" for level in LEVELS)
    now = leaves.select(
        "*",
        leaf_key().alias("leaf"),
        F.to_json(F.struct("domain"), {"ignoreNullFields": "false"}).alias("in_domain"),
        F.to_json(F.struct("domain", "lang"), {"ignoreNullFields": "false"}).alias("in_lang"),
        F.expr(f"CASE WHEN {weighted} THEN tokens * {int(epochs)} ELSE 0 END").alias("capacity"),
    )
    held, tokens_held = now.agg(F.sum("capacity"), F.sum("tokens")).first()
    given = min(held or 0, (tokens_held or 0) if total is None else total)
    domains = _share(
        now.groupBy("in_domain")
        .agg(F.sum("capacity").alias("capacity"), F.max("weight_domain").alias("weight"))
        .withColumns({"given": F.lit(given), "root": F.lit(0)}),
        ["root"],
        "in_domain",
    ).select("in_domain", F.col("budget").alias("given"))
    langs = _share(
        now.groupBy("in_domain", "in_lang")
        .agg(F.sum("capacity").alias("capacity"), F.max("weight_lang").alias("weight"))
        .join(domains, "in_domain"),
        ["in_domain"],
        "in_lang",
    ).select("in_lang", F.col("budget").alias("given"))
    shared = _share(
        now.select("in_lang", "leaf", "tokens", "capacity", F.col("weight_source").alias("weight")).join(langs, "in_lang"),
        ["in_lang"],
        "leaf",
    ).select("leaf", "budget")
    return now.select("leaf", "tokens", "capacity").join(shared, "leaf", "left").fillna(0, ["budget"])


def draw(seed: int, epoch: Column, key: Column) -> Column:
    """Place of a document in a seeded epoch, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))) 


def cuts(costs: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``leaf, budget, epochs, last``: whole epochs of each leaf, and the last draw of the partial one.

    ``costs`` has ``key, leaf, tokens``, ``plan`` is what ``budgets`` returns. The end of a prefix is found in two steps: by a
    histogram of draws, whose size doesn't depend on the leaf's, then among the ids of one bucket.
    """
    plan = plan.select(
        "leaf",
        "budget",
        F.expr("budget DIV greatest(tokens, 1)").alias("epochs"),
        F.expr("budget % greatest(tokens, 1)").alias("rest"),
    )
    drawn = costs.join(plan.filter("rest > 0"), "leaf").select(
        "leaf", "rest", "tokens", draw(seed, F.col("epochs"), F.col("key")).alias("draw")
    )
    drawn = drawn.withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS))
    before = Window.partitionBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        drawn.groupBy("leaf", "rest", "bucket")
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("below", F.coalesce(F.sum("tokens").over(before.orderBy("bucket")), F.lit(0)))
        .filter("below < rest AND below + tokens >= rest")
        .select("leaf", "bucket", "below")
    )
    last = (
        drawn.join(ends, ["leaf", "bucket"])
        .groupBy("leaf", "rest", "below", "draw")
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("start", F.col("below") + F.coalesce(F.sum("tokens").over(before.orderBy("draw")), F.lit(0)))
        .filter("start < rest")
        .groupBy("leaf")
        .agg(F.max("draw").alias("last"))
    )
    return staged(plan.join(last, "leaf", "left").select("leaf", "budget", "epochs", "last"), "cuts")


def copies(key: Column, seed: int = SEED) -> Column:
    """How often a row joined with its leaf's cut is taken."""
    taken = draw(seed, F.col("epochs"), key) <= F.col("last")
    return (F.coalesce(F.col("epochs"), F.lit(0)) + F.when(taken, 1).otherwise(0)).cast("long")


def mixed(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[str, Column],
    total: int | None = None,
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Every row as struct ``row``, with ``leaf``, ``tokens``, ``budget`` and ``copies``.

    ``weights`` has a whole-number column for each level, a function of the level's names. Null and empty
    texts cost one token; null languages and sources are leaves of their own; null ids draw
    like the empty text. Texts are read twice, and not shuffled unless the leaves are too many to broadcast. An empty table gives an empty one.
    """
    rows = docs.select(F.struct("*").alias("row"), domain.alias("domain"), "lang", "source", "doc_id", "text")
    rows = rows.select(
        "row",
        leaf_key().alias("leaf"),
        F.struct("domain", "lang", "source").alias("names"),
        *(weights[level].alias(f"weight_{level}") for level in LEVELS),
        F.col("doc_id").alias("key"),
        tokens(F.col("text")).alias("tokens"),
    )
    costs = staged(rows.drop("row"), "costs")
    leaves = costs.groupBy("names", *(f"weight_{level}" for level in LEVELS)).agg(F.sum("tokens").alias("tokens"))
    plan = staged(budgets(leaves.select("names.*", "*"), total, epochs), "plan")
    cut = cuts(costs.select("key", "leaf", "tokens"), plan, seed)
    return rows.join(by_rows(cut), "leaf", "left").select("row", "leaf", "tokens", "budget", copies(F.col("key"), seed).alias("copies"))
