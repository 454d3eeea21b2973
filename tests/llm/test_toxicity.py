import random

import numpy as np
import pytest
from cases import documents, labels
from pyspark.sql import functions as F

from ticketlens.llm import toxicity
from ticketlens.llm.common import crc_fold
from ticketlens.llm.queries import op10_toxicity


def _corpus(n=1200, seed=1):
    rng = random.Random(seed)
    usual = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "vat") for c in ("a", "is", "om")]
    bad = [f"grobl{x}" for x in ("ik", "us", "ane", "or")]
    rows, marks = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rng.choice(usual) for _ in range(rng.randint(5, 80))]
        if toxic:
            for _ in range(max(1, len(words) // 15)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words).capitalize() + ".", "en", "s", 0))
        marks.append((i, 1, int(toxic)))
    return rows, marks


@pytest.fixture(scope="module")
def fitted(spark):
    rows, marks = _corpus()
    docs = documents(spark, rows)
    return docs, toxicity.fit(docs, labels(spark, [*marks, (3, 1, None), (None, 1, 1)]))


def test_held_out_rows_are_told_apart(spark, fitted):
    docs, models = fitted
    rows = toxicity.scores(docs, models).withColumn("fold", crc_fold(F.col("key"), 5)).filter("fold = 0").collect()
    wrong = [r["key"] for r in rows if (r["score"] >= 0.5) != (r["key"] % 5 == 0)]
    assert len(rows) > 150 and len(wrong) <= 0.03 * len(rows)


def test_rare_forms_share_their_stem(spark, fitted):
    _, models = fitted
    texts = ["karena losolis groblxyz mirenom", "karena losolis zzzzxyz mirenom", "karena losolis grobl", ""]
    found = toxicity.scores(documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), models).collect()
    d = {r["key"]: r["difference"] for r in found}
    assert min(d[0], d[2]) > d[1] + 0.2 and d[1] < 0 and d[3] == 0


def test_probabilities_sum_to_one(fitted):
    models = fitted[1]
    # Words in the vocabulary, and what is left for all others.
    assert models.word.shape == (2, len(models.vocabulary) + 2)
    assert (models.word > 0).all() and (models.share > 0).all()
    assert (models.word[:, 2:].sum(axis=1) < 2).all()


def test_pairs_and_blocks_do_not_matter_to_the_split(spark, fitted, monkeypatch):
    docs, models = fitted
    batch = docs.limit(50).select(toxicity.tokens(F.col("text")).alias("t")).toArrow().to_batches()[0]
    whole = models.score(*toxicity._columns(batch, 0))
    monkeypatch.setattr(toxicity, "_BLOCK", 7)
    assert np.allclose(models.score(*toxicity._columns(batch, 0)), whole)


def test_no_labels_or_one_kind(spark):
    docs = documents(spark)
    for marks in ([], [(1, 1, 1), (5, 1, 1)], [(1, 1, 0), (5, 1, 0), (6, 1, 0)], [(1, 1, None)]):
        models = toxicity.fit(docs, labels(spark, marks))
        rows = toxicity.scores(docs, models).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_rows(awkward, nothing, fitted):
    models = fitted[1]
    rows = toxicity.scores(awkward, models).collect()
    assert len(rows) == awkward.count()
    assert all(r["difference"] == 0 for r in rows if r["key"] in (2, 3, 4))
    assert toxicity.scores(nothing, models).collect() == []


def test_query_finds_toxic_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in op10_toxicity(spark, sf_dir).collect() if r["doc_id"] in marks]
    assert sum(r["predicted"] for r in rows if marks[r["doc_id"]] == 0) == 0
    held = [r["predicted"] for r in rows if r["held_out"] and marks[r["doc_id"]] == 1]
    assert sum(held) >= len(held) / 2


def test_what_is_kept_does_not_shrink_with_the_corpus(spark):
    # Of 30,000 toxic texts 13 hold an insult, and three a pair of otherwise usual words.
    usual = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("w"), F.translate((F.col("id") * 7 + i * i) % 400, "0123456789", "abcdefghij"))), " ")
    toxic = F.col("id") % 5 == 0
    more = (
        F.when(toxic & (F.col("id") < 65), " grobl")
        .when(toxic & (F.col("id") < 80), " halo zube")
        .when(~toxic & (F.col("id") < 2000), " halo mene zube")
        .otherwise("")
    )
    frame = spark.range(150_000).select(toxic.alias("toxic"), toxicity.tokens(F.concat(usual, more)).alias("tokens"))
    models = toxicity._fit_models(frame)
    spoken = spark.createDataFrame([("grobl",), ("halo",), ("zube",)], "text string").select(toxicity.tokens(F.col("text")).alias("t")).collect()
    hashes = [np.array(r["t"]["words"]) for r in spoken]
    grobl, halo, zube = (int(toxicity._numbers(models.vocabulary, h, h)[0]) for h in hashes)
    assert models.vocabulary[grobl - 2] == hashes[0][0]
    assert models.word[toxicity.TOXIC, grobl] > 1.5 * models.word[toxicity.ORDINARY, grobl]
    at = np.searchsorted(models.pairs, halo * (len(models.vocabulary) + 2) + zube)
    assert models.pairs[at] == halo * (len(models.vocabulary) + 2) + zube
    assert models.pair[toxicity.TOXIC, at] > 0
