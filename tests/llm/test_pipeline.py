import hashlib
import re

import pytest
from cases import clashing, documents
from pyspark.sql import functions as F
from test_secrets import _all
from tokenizers import Tokenizer

import corpus_pipeline
from ticketlens.llm import bpe, simhash, toxicity
from ticketlens.llm.common import table
from ticketlens.llm.queries import domain_of, mix_weights


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output rows of each stage over the smallest tables."""
    docs, out = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def test_columns_are_kept(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        assert after.schema.simpleString() == before.schema.simpleString()


def test_toxic_rows_go(stages, spark, sf_dir):
    before, after = stages["toxicity"]
    models = toxicity.fit(before, table(spark, sf_dir, "labels"))
    want = {r["key"] for r in toxicity.scores(before, models).collect() if r["score"] < 0.5}
    assert {r["doc_id"] for r in after.collect()} == want


def test_one_of_each_class_stays(stages):
    before, after = stages["simhash_near_dedup"]
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in before.collect()}
    from test_simhash import _classes

    classes = _classes(prints)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(classes.values()))


def test_secrets_are_masked(stages):
    before, after = stages["secret_scans"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert not _all(r["text"]), r["doc_id"]
        assert len(r["text"]) == r["n_chars"]
        if not _all(texts[r["doc_id"]]):
            assert r["text"] == texts[r["doc_id"]]


def test_mixture_meets_its_budgets(stages):
    before, after = stages["mixing"]
    from ticketlens.llm import mixing

    plan = mixing.mixed(before, domain_of(F.col("source")), mix_weights())
    want = {r["row"]["doc_id"]: r["copies"] for r in plan.collect() if r["copies"]}
    got = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == want


def test_tokens_are_those_of_the_library(stages):
    before, after = stages["bpe"]
    library = Tokenizer.from_file(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert after.count() == before.count()
    for r in after.collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_awkward_rows_pass_all_stages(spark, sf_dir, awkward, nothing):
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, sf_dir)
            assert after.columns == docs.columns
            after.collect()
        corpus_pipeline.encode(spark, docs, sf_dir).collect()
    kept = corpus_pipeline.drop_near_copies(spark, awkward, sf_dir).collect()
    ids = [r["doc_id"] for r in kept]
    assert sorted(i for i in ids if i is not None) == [-9, 1, 2, 5, 6, 7]


def test_repeated_ids_in_different_classes(spark, sf_dir):
    rows = [(1, "one two three four five six", "en", "s", 0), (1, "alpha beta gamma delta epsilon zeta", "en", "s", 0), (2, "one two three four five six", "en", "s", 0)]
    kept = corpus_pipeline.drop_near_copies(spark, clashing(documents(spark, rows)), sf_dir).collect()
    assert sorted(r["text"] for r in kept) == sorted([rows[0][1], rows[1][1]])


def test_no_secret_pattern_is_left_in_the_mask():
    assert not _all(corpus_pipeline.MASK) and not re.search("=", corpus_pipeline.MASK)


def test_null_ids_are_deduplicated(spark, sf_dir):
    named, nameless, alone = "one two three four five six", "alpha beta gamma delta epsilon zeta", "red green blue white black grey"
    rows = [(None, named, "en", "s", 0), (None, named, "en", "s", 0), (3, named, "en", "s", 0), (4, named, "en", "s", 0)]
    rows += [(None, nameless, "en", f"s{i}", 0) for i in range(3)] + [(None, nameless, "en", "s0", 0), (None, alone, "en", "s", 0)]
    kept = corpus_pipeline.drop_near_copies(spark, clashing(documents(spark, rows)), sf_dir).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(3, named), (0, nameless), (0, alone)])


def test_extra_columns_of_any_kind(spark, sf_dir):
    rows = [(1, "one two three four five six", "en", "s", 0)] * 2 + [(None, "one two three four five six", "en", "s", 0), (2, "red green blue white", "en", "s", 0)]
    docs = documents(spark, rows).selectExpr("*", "map('a', doc_id) AS marks", "'x' AS rejected", "'x' AS digest")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    assert docs.columns[-3:] == ["marks", "rejected", "digest"]
    assert {(r["doc_id"], tuple(r["marks"].items())) for r in docs.collect()} == {(1, (("a", 1),)), (2, (("a", 2),))}


def test_verdicts_follow_texts_not_ids(spark, sf_dir, monkeypatch):
    # Stands in for the models: a text with the word is toxic.
    def scored(docs, models, key):
        return docs.select(F.col(key).alias("key"), F.contains(F.coalesce("text", F.lit("")), F.lit("vile")).cast("double").alias("score"))

    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda *a: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "scores", scored)
    rows = [(1, "vile one"), (1, "clean one"), (None, "vile two"), (None, "clean two"), (2, None), (3, ""), (4, "vile one")]
    docs = clashing(documents(spark, [(i, t, "en", "s", 0) for i, t in rows]))
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, [(1, "clean one"), (None, "clean two"), (2, None), (3, "")]))
