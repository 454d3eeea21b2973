"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary texts.

A text is a sequence of lower-cased letter runs. Its score rests on the difference of the two
models' log-likelihoods, divided by its length, turned into a probability by a logistic curve.

*Models.* Interpolated Kneser-Ney of order two per class. As in its lower orders, what counts is not how
often an expression occurs but in how many contexts: in how many different texts. Word pairs back
off to words, words to their stems (first letters), and stems to the counts that both classes share.
On every level a class keeps of a count only the part beyond its discount, and the rest goes to the level
below. The discount is Kneser-Ney's constant plus what the shared counts explain: the expected count
and ``SPREAD`` standard deviations of it. So rare expressions, which tell little, have the same likelihood
in both classes, and rare forms of a telling stem share the stem's counts.
*Calibration.* The curve is fitted on labelled texts that the counts have not seen.

All labelled texts outside the held-out fold are counted; nothing is sampled. A word or stem is kept from
``WORD_TEXTS`` texts of a class on, a pair from ``PAIR_TEXTS``, whatever the size of the corpus, so what is
learnt grows with it; what lies below backs off. Workers hold the kept words and stems, 40 bytes each, and of
the pairs those that tell the classes apart; all other pairs stay in a stored table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import by_rows, crc_fold, let
from ticketlens.session import staged

STEM_LETTERS = 4
WORD_TEXTS, PAIR_TEXTS = 2, 3  # of either class, from which on a word or stem, and a pair, is kept
DISCOUNT = 0.75
SPREAD, PAIR_SPREAD = 5.0, 12.0  # more for pairs, of which far more are tested
BINS, BIN_WIDTH = 20_000, 2e-4  # of length-normalised differences, for the curve
TOXIC, ORDINARY = 0, 1
WORD, STEM = 0, 1
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_BLOCK = 1 << 18  # words of whole texts handled at once


def tokens(text: Column) -> Column:
    """Two arrays of equal length: hashes of a text's words, and of their stems."""
    runs = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}]+", -1), "")
    return let(
        runs,
        lambda w: F.struct(
            F.transform(w, lambda x: F.xxhash64(x)).alias("words"),
            F.transform(w, lambda x: F.xxhash64(F.substring(x, 1, STEM_LETTERS), F.lit("stem"))).alias("stems"),
        ),
    )


def _columns(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, word hashes and stem hashes of a batch."""
    pairs = batch.column(at)
    found = [pairs.field(i) for i in (0, 1)]
    offsets = found[0].offsets.to_numpy()
    flat = [x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in found]
    return offsets - offsets[0], flat[0], flat[1]


Work = Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]


def _in_turn(work: Work) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that holds one batch at a time: each is dropped, and its memory given back, before the next is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        while (batch := next(batches, None)) is not None:
            yield from work(batch)
            del batch

    return run


def _mapped(frame: DataFrame, work: Work, schema: T.StructType | str) -> DataFrame:
    """``work`` over the batches of ``frame``, in batches of ``BATCH_BYTES`` unless the session says otherwise.

    The setting stays with the session. Words of long texts would otherwise fill 64 MB a batch, held several times over.
    """
    spark = frame.sparkSession
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return frame.mapInArrow(_in_turn(work), schema)


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``_BLOCK`` words each; a longer text is a block of its own."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _BLOCK, "right")) - 1)
        yield low, high
        low = high


def _and_null(values: np.ndarray) -> pa.Array:
    """The values, and a null behind them."""
    return pa.array(np.r_[values, 0], pa.int64(), mask=np.r_[np.zeros(len(values), bool), True])


def _distinct(row: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Positions of the first of each (row, keys), ordered by keys."""
    order = np.lexsort((row, *reversed(keys)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in (row, *keys):
        new[1:] |= x[order][1:] != x[order][:-1]
    return order[new]


def _texts_with(frame: DataFrame) -> DataFrame:
    """In how many texts of either class each word and each stem occurs.

    Columns ``kind, hash, stem, toxic, ordinary``; the rows with a null hash are the sums of a kind.
    """
    names = ["kind", "hash", "stem", "toxic", "ordinary"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def counted(kind: int, key: np.ndarray, stem: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> pa.RecordBatch:
        first = _distinct(row, key)
        key, stem, is_toxic = key[first], stem[first], toxic[row[first]]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        in_toxic = np.add.reduceat(is_toxic.astype(np.int64), starts)
        in_ordinary = np.diff(np.r_[starts, len(key)]) - in_toxic
        columns = [
            np.full(len(starts) + 1, kind),
            _and_null(key[starts]),
            _and_null(stem[starts]),
            np.r_[in_toxic, in_toxic.sum()],
            np.r_[in_ordinary, in_ordinary.sum()],
        ]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        offsets, word, stem = _columns(batch, 1)
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for low, high in _blocks(offsets):
            a, b = offsets[low], offsets[high]
            if a < b:
                row = np.repeat(np.arange(low, high), np.diff(offsets[low : high + 1]))
                yield counted(WORD, word[a:b], stem[a:b], row, toxic)
                yield counted(STEM, stem[a:b], stem[a:b], row, toxic)

    partial = _mapped(frame.select("toxic", "tokens"), work, "kind int, hash long, stem long, toxic long, ordinary long")
    return partial.groupBy("kind", "hash").agg(
        F.min("stem").alias("stem"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")
    )


def _numbers(vocabulary: np.ndarray, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
    """Positions in the vocabulary from 2 on; 1 is the unknown word, 0 the start of a text."""

    def look(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(vocabulary):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
        return at, vocabulary[at] == x

    at, known = look(word)
    out = np.where(known, at + 2, 1)
    rare = np.flatnonzero(~known)
    at, known = look(stem[rare])
    out[rare[known]] = at[known] + 2
    return out


def _before(number: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The word before each word; 0 at the start of a text."""
    out = np.r_[0, number[:-1]][: len(number)]
    starts = offsets[:-1][np.diff(offsets) > 0]
    out[starts] = 0
    return out


def _pairs(frame: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``(v, w, toxic, ordinary)``: in how many texts of either class w follows v."""
    size = len(vocabulary) + 2

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        offsets, word, stem = _columns(batch, 1)
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for low, high in _blocks(offsets):
            own = offsets[low : high + 1] - offsets[low]
            if not own[-1]:
                continue
            number = _numbers(vocabulary, word[offsets[low] : offsets[high]], stem[offsets[low] : offsets[high]])
            key = _before(number, own) * size + number
            row = np.repeat(np.arange(low, high), np.diff(own))
            first = _distinct(row, key)
            key, is_toxic = key[first], toxic[row[first]]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            in_toxic = np.add.reduceat(is_toxic.astype(np.int64), starts)
            in_ordinary = np.diff(np.r_[starts, len(key)]) - in_toxic
            pair = key[starts]
            columns = [(pair // size).astype(np.int32), (pair % size).astype(np.int32), in_toxic, in_ordinary]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["v", "w", "toxic", "ordinary"])

    partial = _mapped(frame.select("toxic", "tokens"), work, "v int, w int, toxic long, ordinary long")
    return partial.groupBy("v", "w").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


@dataclass
class Models:
    """Both models, ready to be looked up: per word, per context, per pair."""

    vocabulary: np.ndarray  # sorted hashes
    word: np.ndarray  # (2, words): P(w | class), for stems and the unknown word of any one word they stand for
    share: np.ndarray  # (2, words): mass that a context leaves to the words of its class
    pairs: np.ndarray  # sorted v * size + w
    pair: np.ndarray  # (2, pairs): the excess of the pair, as a share of its context
    curve: tuple[float, float] = (0.0, 0.0)

    def differences(self, number: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log P(w | v, toxic) - log P(w | v, ordinary) of each word."""
        size = len(self.vocabulary) + 2
        held = np.zeros((2, len(number)))
        if len(self.pairs):
            key = before * size + number
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[at] == key
            held[:, hit] = self.pair[:, at[hit]]
        likely = [held[c] + self.share[c][before] * self.word[c][number] for c in (TOXIC, ORDINARY)]
        return np.log(likely[TOXIC]) - np.log(likely[ORDINARY])

    def score(self, offsets: np.ndarray, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """Length-normalised difference of each text; 0 for a text without words."""
        out = np.zeros(len(offsets) - 1)
        for low, high in _blocks(offsets):
            own = offsets[low : high + 1] - offsets[low]
            if not own[-1]:
                continue
            number = _numbers(self.vocabulary, word[offsets[low] : offsets[high]], stem[offsets[low] : offsets[high]])
            total = np.r_[0.0, np.cumsum(self.differences(number, _before(number, own)))]
            out[low:high] = (total[own[1:]] - total[own[:-1]]) / np.maximum(1, np.diff(own))
        return out

    def chance(self, difference: np.ndarray) -> np.ndarray:
        slope, base = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * difference + base, -50, 50)))


def _excess(counts: np.ndarray, totals: np.ndarray, spread: float = SPREAD) -> np.ndarray:
    """What is left of each class's counts after the discount; counts and totals are (2, n) or (2, 1)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        expected = np.nan_to_num(counts.sum(axis=0) * totals / totals.sum(axis=0))
    return np.maximum(counts - expected - spread * np.sqrt(expected) - DISCOUNT, 0)


def _per(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    return counts / np.maximum(totals, 1)


def _rows(table: pa.Table) -> np.ndarray:
    """The rows of a table of whole numbers."""
    return np.stack([c.to_numpy().astype(np.int64) for c in table.columns], axis=1)


def _telling_pairs(pairs: DataFrame) -> DataFrame:
    """``(v, w, toxic, ordinary, all_toxic, all_ordinary)``: kept pairs with an excess in a class, and the sums of their contexts."""
    sums = pairs.groupBy("v").agg(F.sum("toxic").alias("all_toxic"), F.sum("ordinary").alias("all_ordinary"))
    often = pairs.filter(f"toxic >= {PAIR_TEXTS} OR ordinary >= {PAIR_TEXTS}")
    both = F.col("toxic") + F.col("ordinary")
    excess = []
    for c in ("toxic", "ordinary"):
        expected = both * F.col(f"all_{c}") / (F.col("all_toxic") + F.col("all_ordinary"))
        excess.append(F.col(c) - expected - PAIR_SPREAD * F.sqrt(expected) - DISCOUNT)
    # A little wider than _excess, which decides.
    return often.join(by_rows(staged(sums, "contexts")), "v").filter(F.greatest(*excess) > -1e-6)


def _fit_models(frame: DataFrame) -> Models:
    kept = _texts_with(frame).filter(f"hash IS NULL OR toxic >= {WORD_TEXTS} OR ordinary >= {WORD_TEXTS}").toArrow()
    is_total = pc.is_null(kept["hash"])
    totals = np.zeros((2, 2, 1))  # by kind and class
    for r in kept.filter(is_total).to_pylist():
        totals[r["kind"], :, 0] = r["toxic"], r["ordinary"]
    found = _rows(kept.filter(pc.invert(is_total)))
    found = found[np.argsort(found[:, 1])]
    vocabulary, is_word = found[:, 1], found[:, 0] == WORD
    size = len(vocabulary) + 2
    counts = found[:, 3:].T.astype(float)

    # Stems: the class's excess, else the shared counts. Numbers are positions from 2 on; 1 is the unknown word.
    stems, words = np.flatnonzero(~is_word), np.flatnonzero(is_word)
    stem_share = np.full((2, size), 1.0)
    over = _per(_excess(counts[:, stems], totals[STEM]), totals[STEM])
    pooled = _per(counts[:, stems].sum(axis=0), totals[STEM].sum())
    rest = 1 - over.sum(axis=1, keepdims=True)
    stem_share[:] = rest
    stem_share[:, stems + 2] = over / np.maximum(pooled, 1e-300) + rest  # relative to the shared counts

    at = _numbers(vocabulary, found[words, 2], found[words, 2])
    over = _per(_excess(counts[:, words], totals[WORD]), totals[WORD])
    pooled_words = _per(counts[:, words].sum(axis=0), totals[WORD].sum())
    rest = 1 - over.sum(axis=1, keepdims=True)
    unknown = max(1e-6, 1 - pooled_words.sum())
    word = rest * stem_share * unknown
    word[:, stems + 2] = rest * stem_share[:, stems + 2] * pooled
    word[:, words + 2] = over + rest * stem_share[:, at] * pooled_words

    pairs = staged(_pairs(frame, vocabulary), "pairs")
    found = _rows(_telling_pairs(pairs).toArrow())
    before, context = found[:, 0], found[:, 4:].T.astype(float)
    over = _per(_excess(found[:, 2:4].T.astype(float), context, PAIR_SPREAD), context)
    telling = over.any(axis=0)
    found, before, over = found[telling], before[telling], over[:, telling]
    key = before * size + found[:, 1]
    order = np.argsort(key)
    taken = np.zeros((2, size))
    for c in (TOXIC, ORDINARY):
        np.add.at(taken[c], before, over[c])
    return Models(vocabulary, word, np.maximum(1 - taken, 1e-9), key[order], over[:, order])


def _fit_curve(bins: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[float, float]:
    """Slope and base of the logistic curve over binned differences, by Newton's steps."""
    if not toxic.sum() or not ordinary.sum():
        return 0.0, (-4.0 if not toxic.sum() else 4.0)
    unit = 0.01  # so that both weights are of like size
    x = np.stack([bins * BIN_WIDTH / unit, np.ones(len(bins))])
    weight = np.array([0.0, np.log(toxic.sum() / ordinary.sum())])
    n = toxic + ordinary
    ridge = np.diag([1e-2, 1e-6])

    def loss(w):
        z = np.clip(w @ x, -500, 500)
        return float((n * np.logaddexp(0, z) - toxic * z).sum() + (ridge @ w) @ w / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(weight @ x, -500, 500)))
        slope = x @ (n * p - toxic) + ridge @ weight
        step = np.linalg.solve((x * (n * p * (1 - p))) @ x.T + ridge, slope)
        size = 1.0
        while size > 1e-6 and loss(weight - size * step) > loss(weight):
            size /= 2
        weight = weight - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return max(float(weight[0]) / unit, 0.0), float(weight[1])


def _differences(frame: DataFrame, models: Models, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``difference``; ``frame`` has ``tokens`` as its last column."""
    schema = T.StructType([frame.schema[c] for c in keep] + [T.StructField("difference", T.DoubleType())])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = models.score(*_columns(batch, len(keep)))
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found)], [*keep, "difference"])

    return _mapped(frame.select(*keep, "tokens"), work, schema)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Models:
    """Both models and the curve, from labelled texts outside the fold ``held_out``.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``toxic`` (1, 0 or null for
    unknown). The fold after the held-out one calibrates, the others are counted. Without
    labels of one kind, every text gets the same score.
    """
    marked = by_rows(labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").alias("mark")))
    labelled = (
        docs.select("doc_id", "text")
        .withColumn("fold", crc_fold(F.col("doc_id"), folds))
        .filter(F.col("fold") != held_out)
        .join(marked, "doc_id")
        .select("fold", (F.col("mark") == 1).alias("toxic"), tokens(F.col("text")).alias("tokens"))
    )
    check = (held_out + 1) % folds
    models = _fit_models(labelled.filter(F.col("fold") != check))
    checked = _differences(labelled.filter(F.col("fold") == check), models, ["toxic"])
    at = F.least(F.greatest(F.round(F.col("difference") / BIN_WIDTH), F.lit(-BINS)), F.lit(BINS))
    rows = checked.groupBy(at.alias("bin")).agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).collect()
    found = np.array([tuple(r) for r in rows], float).reshape(-1, 3)
    models.curve = _fit_curve(found[:, 0], found[:, 1], found[:, 2])
    return models


def scores(docs: DataFrame, models: Models, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, difference, score)`` for every row; null, empty and wordless texts have difference 0."""
    narrow = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("tokens"))
    slope, base = models.curve
    chance = 1 / (1 + F.exp(-(F.lit(slope) * F.col("difference") + F.lit(base))))
    return _differences(narrow, models, ["key"]).withColumn("score", chance)
