"""Licences in texts, by votes of shared word runs along diagonals. Column expressions and joins only.

All runs of ``RUN`` words of every text are hashed and joined with the runs of the templates. A match of template place t at
text place p votes for the diagonal p - t. Votes are added up by (text, template, diagonal); diagonals that
are at most ``GAP`` apart, as words put in or left out cause them, are one candidate. Each template word that some vote of the candidate
covers has a place in the text; the candidate stands if the covered words are a large enough share of the template and of its span.
A vote counts only where the words themselves are equal, not just their hashes.

Texts are told apart by a digest of their words, so copies vote once, and only votes leave the scan.
Fixed phrases are counted beside this, as base labels.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import let
from ticketlens.session import staged

RUN = 5
GAP = 4
# Templates travel to every task; more words than that are an error, not a larger broadcast.
MOST_TEMPLATE_WORDS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters between words, after A-Z are lowered.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence text or notice; ``least`` is the share of words that must be found, all of them in notices whose versions differ by a word."""

    label: str
    text: str
    least: float = 0.8


# Phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Published licence texts and notices.
TEMPLATES = (
    Template("mit", "Released under the MIT License", 1.0),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", 1.0),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", 1.0),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", 1.0),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", 1.0),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", 1.0),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", 1.0),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", 1.0),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    Template(
        "gnu-family",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)


def normal(text: Column) -> Column:
    """The words of a text, lowered, one blank between two; empty for null and wordless texts."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK, " "))


def _runs(words: Column, run: int) -> Column:
    """Hashes of all runs of words, in order."""
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, run))))
    return F.slice(hashes, F.lit(1), F.greatest(F.size(words) - (run - 1), F.lit(0)))


def _cut(normal_text: Column, run: int) -> Column:
    """Words, and hashes of their runs, each computed once."""
    return let(F.split(normal_text, " "), lambda w: F.struct(w.alias("w"), _runs(w, run).alias("runs")))


def template_runs(spark: SparkSession, templates: Sequence[Template], run: int = RUN) -> DataFrame:
    """``(hash, template, t, run_words)``: every run of every template."""
    found = spark.createDataFrame([(i, t.text) for i, t in enumerate(templates)], "template int, text string")
    words = found.select("template", _cut(normal(F.col("text")), run).alias("cut")).select("template", "cut.w", "cut.runs")
    return words.select("template", "w", F.posexplode("runs").alias("t", "hash")).select(
        "hash", "template", "t", F.slice("w", F.col("t") + 1, F.lit(run)).alias("run_words")
    )


def _lengths(templates: Sequence[Template], run: int) -> list[int]:
    lengths = [len([w for w in "".join(c if c.isalnum() else " " for c in t.text.translate(str.maketrans(UPPER, LOWER))).split(" ") if w]) for t in templates]
    if any(not t.text.isascii() or n < run for t, n in zip(templates, lengths, strict=True)):
        raise ValueError(f"A template needs {run} words or more, in ASCII")
    if sum(lengths) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"Templates hold more than {MOST_TEMPLATE_WORDS} words")
    return lengths


def spans(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text: str = "text", run: int = RUN, gap: int = GAP
) -> DataFrame:
    """``(digest, template, label, first, last, similarity)``: where a template stands in the texts with a digest.

    ``first`` and ``last`` are word numbers. ``similarity`` is the number of template words found, as a share of the template or
    of the span, whichever is longer.
    """
    lengths = _lengths(templates, run)
    parts = let(normal(F.col(text)), lambda n: F.struct(F.md5(n).alias("digest"), _cut(n, run).alias("cut")))
    cut = docs.select(parts.alias("parts")).select("parts.digest", "parts.cut.w", "parts.cut.runs")
    # Outer, since else a filter on the number of runs would be pushed into the scan and cut each text twice.
    places = cut.select("digest", "w", F.posexplode_outer("runs").alias("p", "hash"))
    known = F.broadcast(template_runs(docs.sparkSession, templates, run))
    # Not stated as an equality of the two, which would make the words a join key computed for every place.
    equal = F.array_contains(F.array(F.slice("w", F.col("p") + 1, F.lit(run))), F.col("run_words"))
    votes = places.join(known, "hash").filter(equal).groupBy("digest", "template", (F.col("p") - F.col("t")).alias("diagonal"), "t").agg(F.count("*").alias("copies"))
    votes = staged(votes.drop("copies"), "votes")

    diagonals = votes.groupBy("digest", "template", "diagonal").agg(F.count("*").alias("votes"))
    along = Window.partitionBy("digest", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > gap
    merged = diagonals.withColumn("new", F.coalesce(apart, F.lit(False)).cast("int"))
    merged = merged.select("digest", "template", "diagonal", F.sum("new").over(along).alias("candidate"))
    covered = (
        votes.join(merged, ["digest", "template", "diagonal"])
        .select("digest", "template", "candidate", "diagonal", F.explode(F.sequence("t", F.col("t") + (run - 1))).alias("t"))
        .groupBy("digest", "template", "candidate", "t")
        .agg(F.min("diagonal").alias("diagonal"))
    )
    at = F.col("t") + F.col("diagonal")
    found = covered.groupBy("digest", "template", "candidate").agg(
        F.count("*").alias("covered"), F.min(at).alias("first"), F.max(at).alias("last")
    )

    def of(values: Sequence, kind: str) -> Column:
        return F.get(F.array(*(F.lit(v) for v in values)), F.col("template")).cast(kind)

    longer = F.greatest(of(lengths, "int"), F.col("last") - F.col("first") + 1)
    found = found.withColumn("similarity", F.col("covered").cast("double") / longer.cast("double"))
    return found.filter(F.col("similarity") >= of([t.least for t in templates], "double")).select(
        "digest", "template", of([t.label for t in templates], "string").alias("label"), "first", "last", "similarity"
    )


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(padded: Column, n_words: Column, phrase: str) -> Column:
    """``(n, first, last)`` of a phrase: how often it stands in the padded words, and at which word first and last."""
    bound = F.lit(f" {phrase} ")
    size = len(phrase.split(" "))
    return F.when(
        F.contains(padded, bound),
        F.struct(
            F.regexp_count(padded, F.lit(f"(?<= )(?={phrase} )")).cast("long").alias("n"),
            _blanks(F.substring_index(padded, f" {phrase} ", 1)).cast("long").alias("first"),
            (n_words - size - _blanks(F.substring_index(padded, f" {phrase} ", -1))).cast("long").alias("last"),
        ),
    )


def scan(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    *,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``(key, n_words, n_base, first_word, last_word, base_labels, labels, spans, score)``.

    ``n_base`` counts the places of all phrases; ``first_word`` and ``last_word`` are the smallest and largest start of one, null
    without any. ``labels`` holds the phrases' labels and those of the templates found, ``spans`` the latter with their places. ``score`` is the
    largest similarity of a template found, one where a phrase stands, zero otherwise.

    Null and empty texts have no words and no labels. Rows may repeat and keys may be null or repeat; each row gets its own
    text's result. Equal templates or labels count once. Further columns of any name are ignored; an empty table gives none.
    """
    templates = tuple(templates)
    def measured(n: Column) -> Column:
        n_words = F.when(n == "", 0).otherwise(_blanks(n) + 1).cast("long")
        padded = F.concat(F.lit(" "), n, F.lit(" "))
        each = (_places(padded, n_words, p).alias(f"p{i}") for i, p in enumerate(phrases))
        return F.struct(F.md5(n).alias("digest"), n_words.alias("n_words"), *each)

    found = docs.select(F.col(key).alias("key"), let(normal(F.col(text)), measured).alias("found"))
    each = [F.col(f"found.p{i}") for i in range(len(phrases))]
    base = found.select(
        "key",
        "found.digest",
        "found.n_words",
        sum((F.coalesce(p["n"], F.lit(0)) for p in each), F.lit(0).cast("long")).alias("n_base"),
        F.array_min(F.array(*(p["first"] for p in each), F.lit(None).cast("long"))).alias("first_word"),
        F.array_max(F.array(*(p["last"] for p in each), F.lit(None).cast("long"))).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(p.isNotNull(), F.lit(label)) for p, label in zip(each, phrases.values(), strict=True)))))).alias("base_labels"),
    )
    if not templates:
        none = F.array().cast("array<struct<first:int,last:int,label:string,similarity:double>>")
        held = base.withColumn("spans", none)
    else:
        one = F.struct("first", "last", "label", "similarity")
        by_text = spans(docs, templates, text).groupBy("digest").agg(F.sort_array(F.collect_set(one)).alias("spans"))
        held = base.join(staged(by_text, "spans"), "digest", "left").withColumn("spans", F.coalesce("spans", F.array()))
    best = F.array_max(F.transform("spans", lambda s: s["similarity"]))
    return held.select(
        "key",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        F.array_sort(F.array_union("base_labels", F.transform("spans", lambda s: s["label"]))).alias("labels"),
        "spans",
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
