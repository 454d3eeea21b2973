"""A sparse rule ensemble for text quality.

Statistics of a text are column expressions. Trees fitted on labelled rows give rules: every path from a root to a
node is a conjunction of comparisons. A logistic model with lasso penalty weighs them, most to zero.
The rules that are left are compiled to one column expression, so scoring is a projection.

The fit reads at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hash of their id; scoring covers all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import by_rows, crc_fold, let, words
from ticketlens.session import staged

SAMPLE_ROWS = 20_000
TREES, DEPTH, LEAST_ROWS = 24, 4, 8
LASSO = 0.0005
SEED = 7
STATISTICS = (
    "log_words",
    "word_length",
    "symbols",
    "capitals",
    "marks",
    "digits",
    "pipes",
    "stops",
    "distinct_words",
    "repeated_next",
    "distinct_lines",
    "line_words",
)


def statistics(text: Column) -> Column:
    """Struct of doubles; null and wordless texts have 0 words and ratios of 0."""

    def of(t: Column) -> Column:
        def share(pattern: str, of_what: Column) -> Column:
            return (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / of_what

        def from_words(x: Column) -> Column:
            n = F.greatest(F.size(x["words"]), F.lit(1)).cast("double")
            chars = F.greatest(F.length(t), F.lit(1)).cast("double")
            lines = F.greatest(F.size(x["lines"]), F.lit(1)).cast("double")
            next_same = F.filter(x["words"], lambda w, i: w == F.get(x["words"], i - 1))
            values = {
                "log_words": F.log1p(F.size(x["words"]).cast("double")),
                "word_length": F.length(F.array_join(x["words"], "")) / n,
                "symbols": share("[#*$%&<>]+", n),
                "capitals": share("\\p{Lu}+", chars),
                "marks": share("[!?]+", n),
                "digits": share("[0-9]+", chars),
                "pipes": share("\\|+", n),
                "stops": share("[.,]+", n),
                "distinct_words": F.size(F.array_distinct(x["words"])) / n,
                "repeated_next": F.size(next_same) / n,
                "distinct_lines": F.size(F.array_distinct(x["lines"])) / lines,
                "line_words": F.log1p(F.size(x["words"]) / lines),
            }
            return F.struct(*(values[name].cast("double").alias(name) for name in STATISTICS))

        lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
        return let(F.struct(words(t).alias("words"), lines.alias("lines")), from_words)

    return let(F.coalesce(text, F.lit("")), of)


Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", threshold), all of which must hold


def _column(rule: Rule, source: str) -> Column:
    out = F.lit(True)
    for name, way, at in rule:
        value = F.col(f"{source}.{name}")
        out = out & (value <= at if way == "<=" else value > at)
    return out


def _simplified(steps: list[tuple[str, str, float]]) -> Rule:
    """One comparison for each statistic and way: the tightest."""
    held: dict[tuple[str, str], float] = {}
    for name, way, at in steps:
        old = held.get((name, way))
        held[name, way] = at if old is None else min(old, at) if way == "<=" else max(old, at)
    return tuple(sorted((name, way, at) for (name, way), at in held.items()))


def _paths(node, steps: list[tuple[str, str, float]]) -> list[Rule]:
    """Rules of all paths below a node of a fitted tree."""
    out = [_simplified(steps)] if steps else []
    if node.subtreeDepth() > 0:
        split = node.split()
        name, at = STATISTICS[split.featureIndex()], split.threshold()
        out += _paths(node.leftChild(), [*steps, (name, "<=", at)])
        out += _paths(node.rightChild(), [*steps, (name, ">", at)])
    return out


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[tuple[Rule, float], ...]
    base: float

    def score(self, source: str) -> Column:
        """Chance of label 1 given a struct column of statistics."""
        total = F.lit(self.base)
        for rule, weight in self.rules:
            total = total + F.when(_column(rule, source), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """The ensemble from labelled rows outside the fold ``held_out``.

    ``labels`` has ``doc_id`` and ``quality`` (1, 0 or null for unknown). With labels of one kind only, or none,
    there are no rules and every text gets the same score.
    """
    usable = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").alias("mark"))
    usable = usable.filter(crc_fold(F.col("doc_id"), folds) != held_out)
    sample = by_rows(staged(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(sample_rows), "labelled"))
    rows = (
        docs.select("doc_id", "text")
        .join(sample, "doc_id")
        .select(F.col("mark").cast("double").alias("label"), statistics(F.col("text")).alias("s"))
    )
    rows = staged(rows.select("label", "s.*"), "statistics").repartition(4)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    good, bad = counts.get(1.0, 0), counts.get(0.0, 0)
    if not good or not bad:
        return Ensemble((), math.log((good + 1) / (bad + 1)))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_ROWS, seed=SEED, featureSubsetStrategy="sqrt", maxBins=128
    ).fit(vectors)
    found = {rule for tree in forest._java_obj.trees() for rule in _paths(tree.rootNode(), [])}
    rules = sorted(found)
    holds = rows.select("label", F.struct(*STATISTICS).alias("s")).select(
        "label", *(_column(rule, "s").cast("double").alias(f"r{i}") for i, rule in enumerate(rules))
    )
    names = [f"r{i}" for i in range(len(rules))]
    binary = VectorAssembler(inputCols=names, outputCol="features").transform(holds).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=100, standardization=False).fit(binary)
    weights = lasso.coefficients.toArray().tolist()
    return Ensemble(tuple((r, w) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6), float(lasso.intercept))


def scores(docs: DataFrame, ensemble: Ensemble, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` for every row, empty and null texts included."""
    # One column of statistics, read by many rules: the struct is computed once, as its array element.
    measured = docs.select(F.col(key).alias("key"), F.explode(F.array(statistics(F.col(text)))).alias("s"))
    return measured.select("key", ensemble.score("s").alias("score"))
