import hashlib
import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ticketlens.llm import bpe
from ticketlens.llm.queries import op7_bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def own():
    with open(bpe.default_path(), encoding="utf-8") as file:
        return bpe.WordTokenizer(file.read())


def _same(library, own, texts):
    found = list(own.written(texts))
    for text, one, (n, ids, decoded) in zip(texts, library.encode_batch(texts, add_special_tokens=False), found, strict=True):
        assert (n, ids) == (len(one.ids), " ".join(map(str, one.ids))), text[:80]
        assert decoded == library.decode(one.ids, skip_special_tokens=False)
        assert own.encode(text) == one.ids


def test_odd_texts(library, own):
    rng = random.Random(1)
    letters = "aAbB éÉΣςΑ'sIt'LL 're\n\t  123٣½ⅷ!!??##<|endoftext|>x<|startoftext|>𐐀😀́İıſKÅ\x00\x1c\x85 ​ 語カ한글Ᲊ꟎"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["a" * 3000, "ab" * 2000, "ha" * 777 + "aaa", "", "'" * 300, "!" * 1001, "İ" * 50, "<|endoftext|>", "<|endoftext|", " \n "]
    _same(library, own, texts)


def test_long_words(library, own):
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshrdlu", k=n)) for n in (bpe.LONG_WORD - 1, bpe.LONG_WORD, bpe.LONG_WORD + 1, 5_000)]
    words += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé語", k=80_000)), "x" * 30_001, "ab" * 9_000, "the" * 7_000, "語" * 4_000, "!?" * 3_000]
    started = time.process_time()
    _same(library, own, [*words, " ".join(words)])
    assert time.process_time() - started < 60  # in rounds alone, the longest takes half a minute each time


def test_heap_and_rounds_agree(own, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choices("aabst'é", k=rng.randint(1, 40))) for _ in range(3_000)]
    rounds = own.encode_words(words)
    monkeypatch.setattr(bpe, "LONG_WORD", 0)
    assert [x.tolist() for x in own.encode_words(words)] == [x.tolist() for x in rounds]


def test_all_assigned_and_unassigned_letters(library, own):
    step = 7
    _same(library, own, [f"a{chr(c)}b{chr(c)}" for c in range(1, 0x30000, step) if not 0xD800 <= c <= 0xDFFF])


def test_memo_starts_anew(library, own, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 10)
    monkeypatch.setattr(bpe, "BATCH_WORDS", 5)
    _same(library, own, [f"word{i} again word{i % 7} the end" for i in range(200)])


@pytest.mark.parametrize("longest", [100, 0])
def test_another_vocabulary(monkeypatch, longest):
    monkeypatch.setattr(bpe, "LONG_WORD", longest)
    codes = {c: i for i, c in enumerate("abc")} | {"aa": 3, "ab": 4, "aab": 5, "bc": 6}
    merges = [("a", "a"), ("b", "c"), ("a", "b"), ("aa", "b")]
    table = bpe.Merges.of(codes, merges)
    names = {i: c for c, i in codes.items()}
    for word, want in (("aaa", "aa a"), ("aaaa", "aa aa"), ("aab", "aab"), ("aabc", "aa bc"), ("cab", "c ab"), ("", "")):
        assert " ".join(names[i] for i in table.merged([[codes[c] for c in word]])[0]) == want


def test_awkward_rows(awkward, nothing, library):
    rows = bpe.encoded(awkward).collect()
    texts = [r["text"] or "" for r in awkward.collect()]
    want = sorted(" ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert sorted(r["ids"] for r in rows) == want
    assert bpe.encoded(nothing).collect() == []


def test_query_equals_the_library(spark, sf_dir, library):
    assert bpe.default_path() == public_tokenizers.path("word_bpe_49k.json")

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        one = library.encode(texts[r["doc_id"]], add_special_tokens=False)
        assert r["n_tokens"] == len(one.ids)
        assert r["ids_sha256"] == sha(" ".join(map(str, one.ids)))
        assert r["decoded_sha256"] == sha(library.decode(one.ids, skip_special_tokens=False))
