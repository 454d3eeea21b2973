"""SimHash fingerprints, and the classes of texts whose fingerprints differ in few bits.

Fingerprints are compared exactly, by exclusive-or and bit counts in numpy. Which ones are laid
side by side is decided in three steps, none of which can lose a link:

* equal fingerprints are one class member, so copies are never compared;
* fingerprints within ``radius`` bits agree in full in at least one of ``radius + 1`` bands, so
  only those sharing a band's value meet (one *cell* per band and value);
* a cell with more than ``TILE_ROWS`` members is cut into tiles of one population count each
  (several, if needed), and only tile pairs whose population counts are within the radius are compared,
  each pair as a cell of its own. Inside a cell, members are sorted by population count and
  comparison stops at the first that is too far.

Cells hold at most two tiles, so hot bands spread over tasks. Each cell reports a spanning forest
of its links, at most one link per member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.components import components
from ticketlens.session import staged

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
TILE_ROWS = 2048
_CHUNK = 1 << 16  # shingles, or members of cells, handled at once


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of the word shingles of a text; without words zero.

    A-Z are lowered, words are runs without ASCII white space, repeated shingles count each
    time, and a text shorter than a shingle is one shingle.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(size, len(parts))
    total = len(parts) - size + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, total, _CHUNK):
        high = min(total, low + _CHUNK)
        spans = zip(starts[low:high].tolist(), ends[low + size - 1 : high + size - 1].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """``(key, fp)`` for every row; rows and key values may repeat or be null."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = [fingerprint(texts[i].as_py(), size) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["key", "fp"])

    return narrow.mapInArrow(run, schema)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _forest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member reachable from each of ``count`` members over the links a-b."""
    label = np.arange(count)
    while True:
        left, right = label[a], label[b]
        apart = left != right
        if not apart.any():
            return label
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
        while not np.array_equal(deeper := label[label], label):
            label = deeper


def _cell_links(cell: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest within whole cells.

    Rows are sorted by (cell, population count). In cells with two sides only pairs across
    sides are compared; cells with one side compare all pairs.
    """
    pops = np.bitwise_count(fp).astype(np.int16)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    ends = np.r_[starts[1:], len(cell)]
    end = np.repeat(ends, ends - starts)
    mixed = np.repeat(np.maximum.reduceat(side, starts) != np.minimum.reduceat(side, starts), ends - starts)
    label = np.arange(len(cell))
    active = np.arange(len(cell))
    held_a, held_b, held = [], [], 0
    step = 0
    while True:
        step += 1
        active = active[active + step < end[active]]
        other = active + step
        near = pops[other] - pops[active] <= radius
        active, other = active[near], other[near]
        if not len(active):
            break
        hit = np.bitwise_count(fp[active] ^ fp[other]) <= radius
        hit &= ~mixed[active] | (side[active] != side[other])
        hit &= label[active] != label[other]
        held_a.append(active[hit])
        held_b.append(other[hit])
        held += int(hit.sum())
        if held > 8 * _CHUNK:
            label = _forest(len(cell), np.concatenate([*held_a, np.arange(len(cell))]), np.concatenate([*held_b, label]))
            held_a, held_b, held = [], [], 0
    if held:
        label = _forest(len(cell), np.concatenate([*held_a, np.arange(len(cell))]), np.concatenate([*held_b, label]))
    members = np.flatnonzero(label != np.arange(len(cell)))
    return fp[members].view(np.int64), fp[label[members]].view(np.int64)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def links(parts):
            cell, side, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            # The last cell may go on in the next batch.
            cut = int(np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])[-1])
            return (cell, side, fp), cut

        def found(cell, side, fp):
            u, v = _cell_links(cell, side, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            if sum(len(x[0]) for x in kept) >= _CHUNK:
                (cell, side, fp), cut = links(kept)
                if cut:
                    yield found(cell[:cut], side[:cut], fp[:cut])
                kept = [(cell[cut:], side[cut:], fp[cut:])]
        if kept:
            cell, side, fp = (np.concatenate(x) for x in zip(*kept, strict=True))
            yield found(cell, side, fp)

    return run


def near_links(members: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(u, v)`` links that connect all distinct ``fp`` within ``radius`` bits."""
    bands = radius + 1
    width = 64 // bands
    # The last band takes the bits that are left over.
    value = [
        F.shiftrightunsigned("fp", band * width).bitwiseAND(F.lit((1 << width) - 1) if band < bands - 1 else F.lit(-1))
        for band in range(bands)
    ]
    spread = members.select(
        "fp",
        F.bit_count("fp").cast("int").alias("pop"),
        F.posexplode(F.array(*value)).alias("band", "value"),
    )
    counts = staged(spread.groupBy("band", "value", "pop").count(), "bands")
    sizes = counts.groupBy("band", "value").agg(F.sum("count").alias("rows"))
    hot = sizes.filter(F.col("rows") > tile_rows).select("band", "value")

    cells = spread.join(hot, ["band", "value"], "left_anti").select(
        F.xxhash64("band", "value").alias("cell"), F.lit(0).alias("side"), "fp", "pop"
    )
    splits = (
        counts.join(hot, ["band", "value"])
        .withColumn("splits", F.ceil(F.col("count") / tile_rows))
        .select("band", "value", "pop", "splits")
    )
    tiles = splits.select("band", "value", "pop", F.explode(F.expr("sequence(0L, splits - 1)")).alias("split"))
    pairs = (
        tiles.withColumn("pop2", F.explode(F.sequence(F.col("pop"), F.col("pop") + radius)))
        .join(
            tiles.select("band", "value", F.col("pop").alias("pop2"), F.col("split").alias("split2")),
            ["band", "value", "pop2"],
        )
        .filter("pop2 > pop OR split2 >= split")
        .withColumn("cell", F.xxhash64("band", "value", "pop", "split", "pop2", "split2"))
    )
    ends = pairs.select("band", "value", "pop", "split", "cell", F.lit(0).alias("side")).union(
        pairs.filter("pop2 != pop OR split2 != split").select(
            "band", "value", F.col("pop2").alias("pop"), F.col("split2").alias("split"), "cell", F.lit(1).alias("side")
        )
    )
    tiled = (
        spread.join(splits, ["band", "value", "pop"])
        .withColumn("split", F.pmod(F.xxhash64("fp"), F.col("splits")))
        .join(ends, ["band", "value", "pop", "split"])
        .select("cell", "side", "fp", "pop")
    )
    return (
        cells.union(tiled)
        .repartition("cell")
        .sortWithinPartitions("cell", "pop", "fp")
        .select("cell", "side", "fp")
        .mapInArrow(_compare(radius), "u long, v long")
    )


def near_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``(key, fp, component, root)`` for every row of ``docs``.

    ``component`` is the least key reachable over links of at most ``radius`` differing bits,
    the row's own included; null keys are never the least, and a class with null keys only
    has a null component. Blank and null texts have fingerprint zero and link like
    others. ``root`` names the class, also where two classes share their least key. Repeated rows give
    repeated results; no rows give none.
    """
    own = staged(fingerprints(docs, key, text, size), "fingerprints")
    members = staged(own.groupBy("fp").agg(F.min("key").alias("first")), "members")
    roots = components(near_links(members.select("fp"), radius, tile_rows))
    rooted = members.join(roots, members["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    classes = rooted.join(least, "root").select("fp", "component", "root")
    return own.join(classes, "fp").select("key", "fp", "component", "root")
