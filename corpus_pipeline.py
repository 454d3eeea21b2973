"""A corpus pipeline: toxic texts go, one of each near-duplicate class stays, secrets are masked, sources are
mixed to target weights, and what is left is encoded.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``. All but the last return the columns of
``docs``, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import bpe, mixing, secrets, simhash, toxicity
from ticketlens.llm.common import by_rows, table
from ticketlens.llm.queries import TOXIC_FROM, domain_of, mix_weights
from ticketlens.session import staged

MASK = "[secret]"


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose ``doc_id`` isn't in the staged table ``dropped``; null ids stay."""
    return docs.join(by_rows(dropped), docs["doc_id"] == dropped["doc_id"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity models reject go.

    The verdict is the text's: equal texts share it, and ids play no part, so rows with the same or no id are judged one by
    one. Only digests of texts pass the models; the rejected ones are joined back.
    """
    models = toxicity.fit(docs, table(spark, sf_dir, "labels"), 5, 0)

    def digest(frame: DataFrame) -> Column:
        return F.md5(F.coalesce(frame["text"], F.lit("")).cast("binary"))

    found = toxicity.scores(docs.select(digest(docs).alias("digest"), docs["text"]), models, key="digest")
    rejected = staged(found.filter(F.col("score") >= TOXIC_FROM).select(F.col("key").alias("rejected")).distinct(), "rejected")
    return docs.join(by_rows(rejected), digest(docs) == rejected["rejected"], "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest id stays.

    If the smallest id belongs to several rows of the class, one of them stays, and so does one of a class whose rows all have
    null ids: the one whose JSON comes first.
    """
    found = staged(simhash.near_classes(docs), "classes")
    dropped = staged(found.filter("key != component").select(F.col("key").alias("doc_id")).distinct(), "dropped")
    # An id that repeats within its class or across classes, or is null: rare, and told apart by the whole row.
    repeated = staged(
        found.filter("key IS NOT NULL").groupBy(F.col("key").alias("doc_id")).count().filter("count > 1").select("doc_id"),
        "repeated",
    )
    single = _without(docs.filter("doc_id IS NOT NULL"), staged(dropped.union(repeated).distinct(), "dropped"))
    nameless = docs.filter("doc_id IS NULL")
    several = docs.join(by_rows(repeated), docs["doc_id"] == repeated["doc_id"], "left_semi").unionByName(nameless)
    prints = simhash.fingerprints(several.select(F.struct("*").alias("row"), "text"), key="row").select("key", "fp")
    classes = found.filter("key <=> component").select(F.col("key").alias("_id"), F.col("fp").alias("_fp"), "root").distinct()
    first = prints.join(classes, F.col("key.doc_id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")))
    # Rows are told apart by their JSON, as columns of any kind have one.
    kept = first.groupBy("_id", "root").agg(F.min_by("key", F.to_json("key", {"ignoreNullFields": "false"})).alias("key"))
    return single.unionByName(kept.select("key.*"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by ``MASK``; ``n_chars`` follows. No row goes."""
    spans = secrets.to_mask(F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), F.explode(F.array(spans)).alias("spans"), F.col("text").alias("text"))
    masked = rows.select("row", secrets.masked(F.col("text"), F.col("spans"), MASK).alias("text"))
    out = []
    for name in docs.columns:
        if name == "text":
            out.append(F.col("text"))
        elif name == "n_chars":
            changed = ~F.col("text").eqNullSafe(F.col("row.text"))
            out.append(F.when(changed, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema[name].dataType).alias(name))
        else:
            out.append(F.col(f"row.`{name}`").alias(name))
    return masked.select(*out)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the target mixture takes them, in total about as many tokens as came in."""
    found = mixing.mixed(docs, domain_of(F.col("source")), mix_weights())
    repeated = found.filter("copies > 0").select("row", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    return repeated.select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, number of tokens, and digests of ids and decoded text."""
    return bpe.digests(docs).withColumnRenamed("key", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs


# BPE, fingerprints and language models can't be stated in SQL.
ORACLE_SQL = None
