"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import (
    bpe,
    centroids,
    license_scan,
    mixing,
    quality_rules,
    rule_ensemble,
    secrets,
    sharding,
    simhash,
    token_counts,
    toxicity,
    vptree,
    whitening,
)
from ticketlens.llm.common import crc_fold, table
from ticketlens.session import shared_folder

SHARDS = 8
TOXIC_FROM, GOOD_FROM = 0.5, 0.7
NEIGHBOURS, QUERY_EVERY = 20, 20

# The mixture: weights of domains, languages within a domain, and sources within a language.
DOMAINS = ("web", "reference", "forum", "books")
DOMAIN_WEIGHTS = {"web": 4, "reference": 3, "forum": 2, "books": 1, "other": 1}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS: dict[str, int] = {}


def domain_of(source: Column) -> Column:
    """Domain of a source: by the number in its name; sources without one are ``other``."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    at = F.when(number != "", number.cast("int") % len(DOMAINS))
    return F.coalesce(F.get(F.lit(list(DOMAINS)), at), F.lit("other"))


def mix_weights() -> dict[str, Column]:
    return {
        "domain": mixing.weight(1, DOMAIN_WEIGHTS, domain_of(F.col("source"))),
        "lang": mixing.weight(1, LANG_WEIGHTS, F.col("lang")),
        "source": mixing.weight(1, SOURCE_WEIGHTS, F.col("source")),
    }


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), *quality_rules.BASE, "base_failed", "kept")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_classes(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("key").alias("doc_id"), simhash.as_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, NEIGHBOURS)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("key").alias("doc_id"),
        *(count(kind) for kind in ("assign", "access", "hex")),
        F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ensemble = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"), 4, 2)
    return rule_ensemble.scores(docs, ensemble).select(
        F.col("key").alias("doc_id"),
        (crc_fold(F.col("key"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(table(spark, sf_dir, "documents"), SHARDS)
    return found.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    found = mixing.mixed(docs, domain_of(F.col("source")), mix_weights())
    return found.select(
        "row.doc_id",
        domain_of(F.col("row.source")).alias("domain"),
        "row.lang",
        "row.source",
        "tokens",
        F.col("budget").alias("leaf_budget"),
        "copies",
    )


def edits_of(doc_id: Column, text: Column) -> Column:
    """Four edits of a text that follow from its id and length: one replaces, one deletes, one inserts, one appends."""
    size = F.length(F.coalesce(text, F.lit("")))
    key = F.coalesce(doc_id, F.lit(0))

    def at(salt: int) -> Column:
        return F.pmod(F.crc32(F.concat_ws(":", F.lit(str(salt)), key.cast("string")).cast("binary")), size + 1).cast("int")

    def edit(start: Column, length: int, text: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(length).alias("length"), text.alias("text"))

    return F.array(
        edit(at(1), 7, F.concat(F.lit(" edit "), key.cast("string"))),
        edit(at(2), 40, F.lit("")),
        edit(at(3), 0, F.lit("'s new\n\n  words")),
        edit(size + 100, 0, F.lit(" end.")),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees are built and kept; then edits are applied to the kept ones."""
    folder = shared_folder(spark, "trees")
    token_counts.save(token_counts.trees(table(spark, sf_dir, "documents")), folder)
    found = token_counts.edited(token_counts.current(spark, folder), edits_of(F.col("key"), F.col("text")))
    return found.select(
        F.col("key").alias("doc_id"),
        F.col("n_before").alias("n_tokens"),
        F.col("n_tokens").alias("n_edited"),
        F.col("n_pieces_before").alias("n_pieces"),
        "n_encoded",
        F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = toxicity.fit(docs, table(spark, sf_dir, "labels"), 5, 0)
    return toxicity.scores(docs, models).select(
        F.col("key").alias("doc_id"),
        (crc_fold(F.col("key"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("key", "vec_id")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clustered(table(spark, sf_dir, "embeddings"))
    return centroids.described(found).withColumnRenamed("key", "vec_id")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    joined = (F.array_join(name, ",").alias(name) for name in ("base_labels", "labels"))
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", *joined, "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_simhash,
        op3_nearest,
        op4_secrets,
        op5_quality,
        op6_sharding,
        op7_bpe,
        op8_mixing,
        op9_token_counts,
        op10_toxicity,
        op11_whitening,
        op12_centroids,
        op13_licenses,
    )
}
