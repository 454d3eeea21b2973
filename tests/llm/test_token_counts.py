import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ticketlens.llm import token_counts
from ticketlens.llm.queries import edits_of, op9_token_counts


@pytest.fixture(scope="module")
def counting():
    with open(token_counts.default_path(), "rb") as file:
        ranks = file.read()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return *token_counts.piece_counter(ranks, public_tokenizers.PATTERN), lambda text: len(whole.encode_ordinary(text))


@pytest.mark.parametrize("seed", range(4))
def test_edits_against_encoding_anew(counting, seed):
    pattern, count, whole = counting
    rng = random.Random(seed)

    def some(n):
        return "".join(rng.choice("ab Zé1 2'sre ll\n\n  \t!?'´ 語") for _ in range(rng.randint(0, n)))

    for turn in range(400):
        text = some(rng.choice([5, 40, 400, 20_000 if turn % 40 == 0 else 30]))
        counter = token_counts.Counter(text, pattern, count)
        assert counter.total() == whole(text)
        for _ in range(rng.randint(1, 6)):
            at, length = rng.randint(0, len(text)), rng.choice([0, 0, 1, 2, 5, 30, len(text)])
            new = some(rng.choice([0, 1, 3, 20, 300]))
            counter.edit(at, length, new)
            text = text[:at] + new + text[at + length :]
            assert counter.text == text
            assert counter.total() == whole(text)
            assert [n for block in counter.tree.lengths for n in block] == [len(p) for p in pattern.findall(text)]
            for below, above in zip(counter.tree.levels, counter.tree.levels[1:], strict=False):
                groups = [below[i : i + token_counts.BLOCK] for i in range(0, len(below), token_counts.BLOCK)]
                assert above == [(sum(x for x, _ in g), sum(y for _, y in g)) for g in groups]


def test_only_the_surroundings_are_encoded(counting):
    pattern, count, _ = counting
    counter = token_counts.Counter("some words of a long text. " * 20_000, pattern, count)
    counter.edit(270_000, 4, "other")
    assert counter.encoded < 10


def test_a_kept_tree_is_the_tree(counting):
    pattern, count, whole = counting
    built = token_counts.Counter("some words of a long text. " * 2_000, pattern, count)
    leaves = ([n for block in side for n in block] for side in (built.tree.lengths, built.tree.counts))
    kept = token_counts.Tree.kept(*leaves, [len(b) for b in built.tree.counts], built.tree.sums())
    assert (kept.lengths, kept.counts, kept.levels) == (built.tree.lengths, built.tree.counts, built.tree.levels)

    def encoded(piece):
        assert piece in (" of", " xy", " a", "xy", " xya")
        return count(piece)

    again = token_counts.Counter(built.text, pattern, encoded, kept)
    again.edit(27_014, 0, "xy")
    assert again.total() == whole(again.text) and again.encoded < 4


def test_awkward_rows(awkward, nothing, counting):
    whole = counting[2]
    texts = [r["text"] or "" for r in awkward.collect()]
    edits = F.array(
        F.struct(F.lit(-5).alias("start"), F.lit(2).alias("length"), F.lit("x").alias("text")),
        F.lit(None).cast("struct<start:int,length:int,text:string>"),
        F.struct(F.lit(None).cast("int").alias("start"), F.lit(10**9).alias("length"), F.lit(None).cast("string").alias("text")),
    )
    kept = token_counts.trees(awkward)
    rows = token_counts.edited(kept, edits).collect()
    assert sorted(r["n_before"] for r in rows) == sorted(map(whole, texts))
    assert {(r["n_tokens"], r["n_pieces"], r["text"]) for r in rows} == {(0, 0, "")}
    untouched = token_counts.edited(kept, F.lit(None).cast(token_counts.EDITS)).collect()
    assert sorted(r["n_tokens"] for r in untouched) == sorted(map(whole, texts))
    assert all(r["n_tokens"] == r["n_before"] and r["n_encoded"] == 0 for r in untouched)
    assert token_counts.edited(token_counts.trees(nothing), edits).collect() == []


def test_updates_of_a_folder(spark, counting, tmp_path):
    whole = counting[2]
    folder = f"file://{tmp_path}/trees"
    texts = {i: f"Document {i} " + "some words, 12 of them. " * (i * 40) for i in range(30)} | {None: "no id", 99: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    token_counts.save(token_counts.trees(docs), folder)
    for at, asked in enumerate(({3: (100, 8, "new"), None: (0, 2, "an"), 7: (0, 0, "x" * 500), 1000: (0, 0, "y")}, {3: (5, 1, "\n\n"), 8: (10**6, 0, " end")}, {})):
        rows = [(k, [{"start": s, "length": n, "text": t}]) for k, (s, n, t) in asked.items()]
        files = set(tmp_path.rglob("*.parquet"))
        found = token_counts.update(spark, folder, spark.createDataFrame(rows, f"key long, edits {token_counts.EDITS}")).collect()
        assert files <= set(tmp_path.rglob("*.parquet"))
        for key, (start, length, new) in asked.items():
            if key in texts:
                start = min(start, len(texts[key]))
                texts[key] = texts[key][:start] + new + texts[key][start + length :]
        assert {r["key"]: r["n_tokens"] for r in found} == {k: whole(texts[k]) for k in asked if k in texts}
        assert all(0 < r["n_encoded"] < 12 for r in found)
        held = token_counts.current(spark, folder).collect()
        assert len(held) == len(texts)
        assert {r["key"]: (r["text"], r["n_tokens"]) for r in held} == {k: (t, whole(t)) for k, t in texts.items()}
    twice = spark.createDataFrame([(1, []), (1, [])], f"key long, edits {token_counts.EDITS}")
    with pytest.raises(ValueError, match="one row"):
        token_counts.update(spark, folder, twice)


def test_patterns_of_ones_own(spark, counting):
    docs = spark.createDataFrame([(1, "aab ba, abab")], "doc_id long, text string")
    with pytest.raises(ValueError, match="look_ahead"):
        token_counts.trees(docs, pattern="[a-z]+|[^a-z]+")
    kept = token_counts.trees(docs, pattern="[a-z]+|[^a-z]+", look_ahead=1)
    step = F.array(F.struct(F.lit(3).alias("start"), F.lit(1).alias("length"), F.lit("").alias("text")))
    row = token_counts.edited(kept, step, pattern="[a-z]+|[^a-z]+", look_ahead=1).first()
    assert (row["text"], row["lengths"], row["n_pieces_before"]) == ("aabba, abab", [5, 2, 4], 5)
    with pytest.raises(Exception, match="leaves characters out"):
        token_counts.trees(docs, pattern="[a-z]+", look_ahead=0).collect()


def test_query_against_encoding_anew(spark, sf_dir, counting):
    whole = counting[2]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {}
    for r in docs.select("doc_id", "text", edits_of(F.col("doc_id"), F.col("text")).alias("edits")).collect():
        text = r["text"]
        for e in r["edits"]:
            at = min(e["start"], len(text))
            text = text[:at] + e["text"] + text[at + e["length"] :]
        want[r["doc_id"]] = (whole(r["text"]), whole(text))
    rows = op9_token_counts(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["n_edited"]) for r in rows} == want
