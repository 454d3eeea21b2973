"""Byte-pair encoding in batched rounds, and decoding.

The symbols of many words lie in one flat array. In a round, every pair of neighbours within a word is
looked up by binary search in the sorted keys of the merge table; each word then merges all places of its lowest
rank, left to right. Words without a known pair leave the batch. What comes out is what merging one pair at a
time gives: a merge makes no pair of lower rank than its own before all pairs of that rank are merged, other than
by symbols that it has made, which the next round sees.

A round reads every symbol that is left, so a very long word would take a time that grows with the square of its
length. Words of more than ``LONG_WORD`` symbols are merged one pair at a time from a heap, with the same result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from ticketlens.llm.common import once

MEMO_WORDS = 300_000  # different words whose codes a worker keeps; then it starts anew
BATCH_WORDS = 20_000  # words merged at once
LONG_WORD = 100  # symbols of a word that rounds still merge


@dataclass
class Merges:
    """A merge table: sorted keys ``left * size + right`` with rank and outcome."""

    size: int
    keys: np.ndarray
    rank: np.ndarray
    made: np.ndarray

    @classmethod
    def of(cls, codes: dict[str, int], merges: Sequence[tuple[str, str]]) -> Merges:
        size = max(codes.values(), default=0) + 1
        rows = np.array([(codes[a] * size + codes[b], i, codes[a + b]) for i, (a, b) in enumerate(merges)], np.int64).reshape(-1, 3)
        # Of a pair that is listed twice the later rank holds.
        rows = rows[np.lexsort((-rows[:, 1], rows[:, 0]))]
        rows = rows[np.r_[True, rows[1:, 0] != rows[:-1, 0]][: len(rows)]]
        return cls(size, rows[:, 0].copy(), rows[:, 1].copy(), rows[:, 2].copy())

    def merged(self, symbols: Sequence[Sequence[int]]) -> list[np.ndarray]:
        """The codes of each word, given its first symbols."""
        out = [self._one_by_one(s) if len(s) > LONG_WORD else np.zeros(0, np.int64) for s in symbols]
        short = [() if len(s) > LONG_WORD else s for s in symbols]
        lengths = np.array([len(s) for s in short], np.int64)
        flat = np.fromiter((x for s in short for x in s), np.int64, int(lengths.sum()))
        word = np.repeat(np.arange(len(symbols)), lengths)
        none = np.iinfo(np.int64).max
        while len(flat):
            ranks = np.full(len(flat), none)
            at = np.zeros(len(flat), np.int64)
            if len(flat) > 1 and len(self.keys):
                key = flat[:-1] * self.size + flat[1:]
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = (self.keys[found] == key) & (word[:-1] == word[1:])
                ranks[:-1][known] = self.rank[found[known]]
                at[:-1] = found
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            ends = np.r_[starts[1:], len(flat)]
            least = np.minimum.reduceat(ranks, starts)
            for i in np.flatnonzero(least == none).tolist():
                out[word[starts[i]]] = flat[starts[i] : ends[i]]
            going = np.repeat(least != none, ends - starts)
            merge = going & (ranks == np.repeat(least, ends - starts))
            # A run of overlapping places (a a a ...) merges at its first, third, ... place.
            places = np.flatnonzero(merge)
            if len(places):
                heads = np.flatnonzero(np.r_[True, np.diff(places) != 1])
                within = np.arange(len(places)) - np.repeat(heads, np.diff(np.r_[heads, len(places)]))
                places = places[within % 2 == 0]
                flat[places] = self.made[at[places]]
                going[places + 1] = False
            flat, word = flat[going], word[going]
        return out

    @cached_property
    def _listed(self) -> tuple[list[int], list[int], list[int]]:
        return self.keys.tolist(), self.rank.tolist(), self.made.tolist()

    def _one_by_one(self, symbols: Sequence[int]) -> np.ndarray:
        """The codes of one word: always the leftmost pair of the lowest rank, in n log n steps."""
        keys, ranks, made = self._listed
        codes, n, bits = list(symbols), len(symbols), len(symbols).bit_length()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def known(place: int) -> int:
            """Where the pair that starts at a place stands in the table, or -1."""
            if after[place] == n:
                return -1
            key = codes[place] * self.size + codes[after[place]]
            at = bisect_left(keys, key)
            return at if at < len(keys) and keys[at] == key else -1

        # A waiting pair is one number, its rank before its place; those that have changed since are passed over.
        waiting = [ranks[at] << bits | place for place in range(n) if (at := known(place)) >= 0]
        heapq.heapify(waiting)
        while waiting:
            rank, place = divmod(heapq.heappop(waiting), 1 << bits)
            if codes[place] < 0 or (at := known(place)) < 0 or ranks[at] != rank:
                continue
            gone = after[place]
            codes[place], codes[gone] = made[at], -1
            after[place] = after[gone]
            if after[gone] < n:
                before[after[gone]] = place
            for start in (before[place], place):
                if start >= 0 and (at := known(start)) >= 0:
                    heapq.heappush(waiting, ranks[at] << bits | start)
        return np.array([c for c in codes if c >= 0], np.int64)


def _bytes_as_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it is printable, else the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _unassigned() -> tuple[str, str]:
    """Letters and digits, and capitals, that ``regex`` knows of but Python and the tokenizer may not.

    Both as insides of character classes; of the first, those that the tokenizer takes for neither.
    """
    free = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    newer = regex.findall(r"[\p{L}\p{N}]", free)
    split = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True)
    known = {c for piece, _ in split.pre_tokenize_str("".join(newer)) for c in piece}
    return _class([c for c in newer if c not in known]), _class(regex.findall(r"\p{Lu}", free))


def _latin_pattern(pattern: str) -> re.Pattern:
    """The same pattern for texts of code points below 256, on the faster built-in engine."""

    def inside(kinds: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] in kinds)

    spaces = "".join(re.escape(c) for c in map(chr, range(256)) if regex.match(r"\s", c))
    return re.compile(pattern.replace("\\p{L}", inside("L")).replace("\\p{N}", inside("N")).replace("\\s", spaces))


def _class(letters: list[str]) -> str:
    return "".join(f"{regex.escape(run[0])}-{regex.escape(run[-1])}" for run in _runs(letters))


def _runs(letters: list[str]) -> Iterator[str]:
    run = ""
    for c in letters:
        if run and ord(c) != ord(run[-1]) + 1:
            yield run
            run = ""
        run += c
    if run:
        yield run


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordTokenizer:
    """Lower-casing byte-level BPE with word ends, as its file describes it.

    White space separates words and is lost. Special tokens found in a text count as tokens.
    """

    def __init__(self, described: str):
        told = json.loads(described)
        model = told["model"]
        self.codes: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.names = {i: t for t, i in self.codes.items()} | {i: t for t, i in self.special.items()}
        self.end: str = model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges.of(self.codes, pairs)
        pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.latin = _latin_pattern(pattern)
        odd, capitals = _unassigned()
        self.new_capitals = regex.compile(f"[{capitals}]") if capitals else None
        if odd:
            pattern = (
                pattern.replace("[^\\s\\p{L}\\p{N}]+", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{odd}])+")
                .replace("[\\p{L}]+", f"[\\p{{L}}--[{odd}]]+")
                .replace("|[\\p{N}]|", f"|[\\p{{N}}--[{odd}]]|")
            )
        self.pieces = regex.compile(pattern, regex.V1)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.first = {b: self.codes[x] for b, x in _bytes_as_letters().items()}
        self.last = {b: self.codes[x + self.end] for b, x in _bytes_as_letters().items()}
        self.memo: dict[str, tuple[str, str]] = {}

    def words(self, text: str) -> list[str]:
        """Normal forms of the words of a text in order; special tokens as they are."""
        out: list[str] = []
        for i, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if i % 2:
                out.append(part)
            elif _is_latin(part):  # nothing to compose, nothing odd to lower
                out += self.latin.findall(part.lower())
            elif part:
                part = unicodedata.normalize("NFC", part)
                if self.new_capitals and self.new_capitals.search(part):
                    part = normalizers.Lowercase().normalize_str(part)
                # Each letter is lowered by itself, so a final sigma is no special case.
                out += self.pieces.findall(part.replace("Σ", "σ").lower())
        return out

    def encode_words(self, words: Sequence[str]) -> list[np.ndarray]:
        symbols = []
        for w in words:
            if w in self.special:
                symbols.append([self.special[w]])
                continue
            spelled = w.encode("utf-8")
            symbols.append([*map(self.first.__getitem__, spelled[:-1]), self.last[spelled[-1]]])
        return [c for low in range(0, len(symbols), BATCH_WORDS) for c in self.merges.merged(symbols[low : low + BATCH_WORDS])]

    def decode(self, ids: Sequence[int]) -> str:
        """Names of the tokens with blanks between, as the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return [i for codes in self.encode_words(self.words(text)) for i in codes.tolist()]

    def written(self, texts: Sequence[str]) -> Iterator[tuple[int, str, str]]:
        """Number of tokens, decimal ids joined by blanks, and decoded text of each text."""
        held: list[list[str]] = []
        size = 0

        def ready() -> Iterator[tuple[int, str, str]]:
            new = list(set().union(*held) - self.memo.keys())
            for w, codes in zip(new, self.encode_words(new), strict=True):
                ids = codes.tolist()
                self.memo[w] = (" ".join(map(str, ids)), self.decode(ids))
            for doc in held:
                if doc:
                    ids, decoded = map(" ".join, zip(*map(self.memo.__getitem__, doc), strict=True))
                    yield ids.count(" ") + 1, ids, decoded
                else:
                    yield 0, "", ""
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()

        for text in texts:
            held.append(self.words(text))
            size += len(held[-1])
            if size >= 4 * BATCH_WORDS:
                yield from ready()
                held, size = [], 0
        yield from ready()


def _tokenizer(described: str) -> WordTokenizer:
    return once(("word tokenizer", described), lambda: WordTokenizer(described))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, n_tokens, ids, decoded`` for every row; null counts as the empty text, which has no tokens.

    ``ids`` is the text of the decimal ids joined by blanks. ``path`` names the tokenizer's file on
    the driver; its content travels with the job.
    """
    return _run(docs, key, text, path, False)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """As ``encoded``, with the SHA-256 of both texts in their place: ``ids_sha256``, ``decoded_sha256``."""
    return _run(docs, key, text, path, True)


def _run(docs: DataFrame, key: str, text: str, path: str | None, digest: bool) -> DataFrame:
    with open(path or default_path(), encoding="utf-8") as file:
        described = file.read()
    shipped = docs.sparkSession.sparkContext.broadcast(described)
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]
    kinds = [T.LongType(), T.StringType(), T.StringType()]
    schema = T.StructType([narrow.schema["key"], *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    def sha(x: str) -> str:
        return hashlib.sha256(x.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shipped.value)
        for batch in batches:
            texts = batch.column(1)
            found = tokenizer.written(x.as_py() for x in texts)
            if digest:
                found = ((n, sha(a), sha(b)) for n, a, b in found)
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["key", *names])

    return narrow.mapInArrow(run, schema)
