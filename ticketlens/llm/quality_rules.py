"""Quality rules whose thresholds adapt to each language and source.

Every text is measured once. The measures of a (language, source) group go into a quantile sketch, from
which the group's fences are read; the fences are joined back and filter the rows.

The sketch is a histogram over fixed buckets whose width is at most 1/64 of their value (whole numbers up
to 128 have buckets of their own). Sketches of two groups, or of two days, merge by adding counts,
in any order, with the same result. To every group's sketch, those of its language and of all rows are added with the
weight of ``PRIOR`` rows each, at every size: a group of few rows is judged nearly by them, a large one by its own. A
sketch has at most some 3,700 buckets, however many rows it stands for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import SPACES, let, words
from ticketlens.session import staged

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30  # the base rule: words, and percent of words in repeated windows
PRIOR = 20  # rows of a group that its language, and that all rows weigh as much as
UNIT = 1000  # weight of a row
SLACK = 5  # distance of a fence that is granted to groups of equal values
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A whole-number measure and where its fence stands.

    ``tail`` is the quantile per mille where the upper tail begins; the fence lies ``reach`` distances from the median to
    it, and ``SLACK``, beyond. ``low`` sets a fence below, too, from the mirrored quantile.
    """

    name: str
    value: str
    tail: int = 900
    reach: int = 3
    low: bool = False


# Repetition is none for most ordinary texts, so its spread says nothing: its fences stand at the quantile itself.
RULES = (
    Rule("symbols", "1000 * n_symbols DIV greatest(n_words, 1)"),
    Rule("capitals", "1000 * n_capitals DIV greatest(word_chars, 1)"),
    Rule("marks", "1000 * n_marks DIV greatest(n_words, 1)"),
    Rule("dup_lines", "1000 * n_dup_lines DIV greatest(n_lines, 1)", tail=990, reach=0),
    Rule("repeated", "1000 * n_repeat_words DIV greatest(n_words, 1)", tail=990, reach=0),
    Rule("word_length", "100 * word_chars DIV greatest(n_words, 1)", low=True),
)


def _repeated(w: Column) -> Column:
    """Words covered by windows that occur twice or more in the text."""
    last = F.size(w) - WINDOW + 1
    starts = F.sequence(F.lit(1), last)

    def covered(sorted_windows: Column) -> Column:
        hits = F.filter(
            sorted_windows,
            lambda x, i: x["text"].eqNullSafe(F.get(sorted_windows, i - 1)["text"])
            | x["text"].eqNullSafe(F.get(sorted_windows, i + 1)["text"]),
        )
        places = F.sort_array(F.transform(hits, lambda x: x["at"]))
        state = F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            places,
            state,
            lambda s, at: F.struct(
                (s["words"] + F.least(F.lit(WINDOW), at - s["last"])).alias("words"), at.alias("last")
            ),
            lambda s: s["words"],
        )

    # Texts without two equal hashes, nearly all, are done here; for the others the windows themselves are compared.
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    windows = F.transform(
        starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("text"), i.alias("at"))
    )
    has_repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    found = F.when(has_repeats, let(F.sort_array(windows), covered)).otherwise(0)
    return F.when(F.size(w) >= WINDOW, found).otherwise(0)


def measures(text: Column) -> Column:
    """All counts of a text as a struct of longs; null counts as the empty text."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(SPACES.replace("[", "[^")))

        def counted(x: Column) -> Column:
            parts = {
                "n_words": F.size(x["words"]),
                "word_chars": F.length(F.array_join(x["words"], "")),
                "n_symbols": F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, "")),
                "n_dup_lines": F.size(x["lines"]) - F.size(F.array_distinct(x["lines"])),
                "n_repeat_words": _repeated(x["words"]),
                "n_lines": F.size(x["lines"]),
                "n_capitals": F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}+", "")),
                "n_marks": F.length(t) - F.length(F.regexp_replace(t, "[!?]+", "")),
            }
            return F.struct(*(value.cast("long").alias(name) for name, value in parts.items()))

        return let(F.struct(words(t).alias("words"), lines.alias("lines")), counted)

    return let(F.coalesce(text, F.lit("")), of)


def bucket(value: Column) -> Column:
    """Least value of the sketch bucket that a whole number from 0 on falls into."""
    extra = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, extra), extra)


def sketch(measured: DataFrame) -> DataFrame:
    """``lang, source, rule, bucket, rows``; add up ``rows`` to merge sketches."""
    values = F.array(*(F.struct(F.lit(r.name).alias("rule"), bucket(F.expr(r.value)).alias("bucket")) for r in RULES))
    return (
        measured.select("lang", "source", F.explode(values).alias("x"))
        .groupBy("lang", "source", "x.rule", "x.bucket")
        .agg(F.count("*").alias("rows"))
    )


def blended(sketches: DataFrame) -> DataFrame:
    """``lang, source, rule, bucket, weight``: each group's sketch with its language's and that of all rows added.

    A row of the group weighs ``UNIT``, the others together ``PRIOR * UNIT`` each, rounded down by bucket.
    """
    names = sketches.select("lang", "source", "rule").distinct()

    def prior(*of: str) -> DataFrame:
        merged = sketches.groupBy(*of, "rule", "bucket").agg(F.sum("rows").alias("rows"))
        total = sketches.groupBy(*of, "rule").agg(F.sum("rows").alias("total"))
        keys = [*of, "rule"]
        there = total.select(*(F.col(k).alias(f"t_{k}") for k in keys), "total")
        weighed = (
            merged.join(there, _same(keys, "t_"))
            .withColumn("weight", F.expr(f"{PRIOR * UNIT} * rows DIV total"))
            .select(*(F.col(k).alias(f"p_{k}") for k in keys), "bucket", "weight")
        )
        return names.join(weighed, _same(keys, "p_")).select("lang", "source", "rule", "bucket", "weight")

    own = sketches.select("lang", "source", "rule", "bucket", (UNIT * F.col("rows")).alias("weight"))
    parts = own.union(prior("lang")).union(prior())
    return parts.groupBy("lang", "source", "rule", "bucket").agg(F.sum("weight").alias("weight"))


def _same(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys))


def fences(sketches: DataFrame) -> DataFrame:
    """``lang, source, limits``: a struct of ``low`` and ``high`` for each rule.

    A quantile is the least bucket that reaches its share of the blended sketch's weight.
    """
    group = Window.partitionBy("lang", "source", "rule")
    ranked = (
        blended(sketches)
        .withColumn("upto", F.sum("weight").over(group.orderBy("bucket")))
        .withColumn("total", F.sum("weight").over(group))
    )

    def quantile(per_mille: Column) -> Column:
        # Whole parts first: the weight times a thousand could leave the range of long numbers.
        reached = F.col("upto") >= F.expr("total DIV 1000") * per_mille + F.ceil(F.col("total") % 1000 * per_mille / 1000)
        return F.min(F.when(reached, F.col("bucket")))

    tail = reduce(lambda c, r: c.when(F.col("rule") == r.name, r.tail), RULES, F.when(F.lit(False), 0))
    found = ranked.groupBy("lang", "source", "rule").agg(
        quantile(1000 - tail).alias("bottom"), quantile(F.lit(500)).alias("middle"), quantile(tail).alias("top")
    )
    limits = []
    for r in RULES:
        own = F.col("rule") == r.name
        low = F.col("bottom") - r.reach * (F.col("middle") - F.col("bottom")) - SLACK if r.low else F.lit(0)
        high = F.col("top") + r.reach * (F.col("top") - F.col("middle")) + SLACK
        limits.append(F.max(F.when(own, low)).cast("long").alias(f"low_{r.name}"))
        limits.append(F.max(F.when(own, high)).cast("long").alias(f"high_{r.name}"))
    wide = found.groupBy("lang", "source").agg(*limits)
    return wide.select("lang", "source", F.struct(*(c for c in wide.columns if c.startswith(("low_", "high_")))).alias("limits"))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the counts, ``base_failed``, ``broken`` (names of rules broken) and ``kept`` for every row.

    The base rule fails texts with fewer than 20 words or with more than 30 percent of their
    words in repeated windows; the adaptive rules reject what lies outside the fences of its group. Null texts
    count as empty, null languages and sources are groups of their own.
    """
    narrow = docs.select(F.col(key).alias("key"), "lang", "source", measures(F.col(text)).alias("m"))
    measured = staged(narrow.select("key", "lang", "source", "m.*"), "measures")
    # Fences judge texts that the base rule lets pass, and are read from all of those. Failed ones have their verdict; with
    # them, one text in ten or so would put the fence of repetition near a thousand per mille.
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    sketches = staged(sketch(measured.filter(~F.col("base_failed"))), "sketch")
    limits = staged(fences(sketches), "fences").select(F.col("lang").alias("l"), F.col("source").alias("s"), "limits")
    same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    broken = []
    for r in RULES:
        value = F.expr(r.value)
        out = (value < F.col(f"limits.low_{r.name}")) | (value > F.col(f"limits.high_{r.name}"))
        broken.append(F.when(out, F.lit(r.name)))
    named = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*broken)))
    return (
        measured.join(limits, same, "left")
        .withColumn("broken", named)
        .select("key", "lang", "source", *BASE, "base_failed", "broken", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))
    )
