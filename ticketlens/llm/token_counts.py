"""Token counts that follow edits without encoding a text anew.

A text is cut into pre-tokens, each of which has a number of tokens. The numbers are the leaves of a segment
tree, whose root is the text's count. ``trees`` builds one per document, a row that is kept with the text.
An edit replaces a range of characters. Where a piece ends depends on the
characters from its start on, and on at most ``LOOK_AHEAD`` characters beyond its end; so pieces that end
further before the edit stay. From there the text is cut anew until a cut falls on an old one behind the edit;
from that on all is as it was. Only the new pieces are encoded, and only sums above changed
leaves are computed. ``edited`` reads kept trees and gives them in the same form, to be kept again;
``save``, ``update`` and ``current`` keep them in a folder, where an update writes edited documents alone.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import by_rows, once, small_batches

LOOK_AHEAD = 3  # the longest alternative after an apostrophe has two letters; one more for white space before a word
BLOCK = 64  # leaves below a node of the lowest level; also the fan-out above
MEMO_PIECES = 200_000
FLUSH_PIECES = 1 << 17  # of finished rows, after which a batch is handed on
EDITS = "array<struct<start:int,length:int,text:string>>"
_INTS, _SUMS = pa.list_(pa.int32()), pa.list_(pa.struct([("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))]))
# A kept tree: its leaves, the number of leaves in each block, and the sums of each level from the blocks up.
TREE = "lengths array<int>, counts array<int>, sizes array<int>, sums array<struct<chars:array<bigint>,tokens:array<bigint>>>"


class Tree:
    """Pieces of a text in blocks, with sums of characters and tokens of each block, and sums of those above."""

    def __init__(self, lengths: Sequence[int], counts: Sequence[int]):
        self.lengths = [list(lengths[i : i + BLOCK]) for i in range(0, len(lengths), BLOCK)]
        self.counts = [list(counts[i : i + BLOCK]) for i in range(0, len(counts), BLOCK)]
        self.levels: list[list[tuple[int, int]]] = []
        self._sum_from(0)

    @classmethod
    def kept(cls, lengths: Sequence[int], counts: Sequence[int], sizes: Sequence[int], sums: Iterable[dict]) -> Tree:
        """The tree with these leaves, blocks and sums; nothing is added up."""
        tree = cls.__new__(cls)
        tree.lengths, tree.counts, at = [], [], 0
        for size in sizes:
            tree.lengths.append(lengths[at : at + size])
            tree.counts.append(counts[at : at + size])
            at += size
        tree.levels = [list(zip(level["chars"], level["tokens"], strict=True)) for level in sums]
        return tree

    def sums(self) -> list[dict]:
        return [{"chars": [x[0] for x in level], "tokens": [x[1] for x in level]} for level in self.levels]

    def _sum_from(self, block: int) -> None:
        """Sums of the nodes above the blocks from ``block`` on, whose number may have changed."""
        old = self.levels
        below = (old[0][:block] if old else []) + [
            (sum(a), sum(b)) for a, b in zip(self.lengths[block:], self.counts[block:], strict=True)
        ]
        self.levels = [below]
        depth, start = 1, block // BLOCK
        while len(below) > 1:
            kept = old[depth][:start] if depth < len(old) else []
            start = len(kept)
            below = kept + [
                (sum(x[0] for x in below[i : i + BLOCK]), sum(x[1] for x in below[i : i + BLOCK]))
                for i in range(start * BLOCK, len(below), BLOCK)
            ]
            self.levels.append(below)
            depth, start = depth + 1, start // BLOCK

    def total(self) -> int:
        return sum(x[1] for x in self.levels[-1])

    def size(self) -> int:
        return sum(x[0] for x in self.levels[-1])

    def find(self, place: int) -> tuple[int, int, int]:
        """Block, position in it, and first character, of the piece that holds character ``place``.

        Behind the last character it is the end: one past the last block's last piece.
        """
        if not self.counts:
            return 0, 0, 0
        node, start = 0, 0
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            last = min(len(level), node + BLOCK) - 1 if depth < len(self.levels) - 1 else len(level) - 1
            while node < last and start + level[node][0] <= place:
                start += level[node][0]
                node += 1
            if depth:
                node *= BLOCK
        at = 0
        while at < len(self.lengths[node]) and start + self.lengths[node][at] <= place:
            start += self.lengths[node][at]
            at += 1
        return node, at, start

    def replace(self, first: tuple[int, int], behind: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Put new pieces in place of those from ``first`` up to, without, ``behind`` (block, position)."""
        if not self.counts:
            self.__init__(lengths, counts)
            return
        (a, i), (b, j) = first, behind
        new_lengths = self.lengths[a][:i] + lengths + self.lengths[b][j:]
        new_counts = self.counts[a][:i] + counts + self.counts[b][j:]
        step = BLOCK if len(new_counts) > 2 * BLOCK else max(1, len(new_counts))
        blocks = range(0, len(new_counts), step)
        shifted = len(blocks) != b - a + 1
        self.lengths[a : b + 1] = [new_lengths[k : k + step] for k in blocks]
        self.counts[a : b + 1] = [new_counts[k : k + step] for k in blocks]
        if shifted:
            self._sum_from(a)  # blocks behind moved to other parents
        else:
            self._update(a, b)

    def _update(self, a: int, b: int) -> None:
        self.levels[0][a : b + 1] = [(sum(self.lengths[k]), sum(self.counts[k])) for k in range(a, b + 1)]
        for below, level in zip(self.levels, self.levels[1:], strict=False):
            a, b = a // BLOCK, b // BLOCK
            for k in range(a, b + 1):
                part = below[k * BLOCK : (k + 1) * BLOCK]
                level[k] = (sum(x[0] for x in part), sum(x[1] for x in part))


class Counter:
    """A text with its tree, kept or built; ``count(piece)`` tells the tokens of a piece."""

    def __init__(
        self,
        text: str,
        pattern: regex.Pattern,
        count: Callable[[str], int],
        tree: Tree | None = None,
        look_ahead: int = LOOK_AHEAD,
    ):
        self.text, self.pattern, self.count, self.look_ahead = text, pattern, count, look_ahead
        if tree is None:
            # Without groups findall gives whole matches, faster.
            pieces = [found.group() for found in pattern.finditer(text)] if pattern.groups else pattern.findall(text)
            tree = Tree([len(p) for p in pieces], [count(p) for p in pieces])
            if tree.size() != len(text):
                raise ValueError("The pattern leaves characters out")
        self.tree = tree
        self.encoded = 0  # pieces encoded because of edits

    def total(self) -> int:
        return self.tree.total()

    def edit(self, start: int, length: int, new: str) -> None:
        """Replace ``length`` characters from ``start`` on; what lies outside the text is left out."""
        start = min(max(start, 0), len(self.text))
        end = min(start + max(length, 0), len(self.text))
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        a, i, begin = self.tree.find(max(0, start - self.look_ahead))
        lengths: list[int] = []
        counts: list[int] = []
        place = begin
        b, j, old = self.tree.find(end)
        if old < end:  # the edit ends within this piece
            old, b, j = self._next(b, j, old)
        for found in self.pattern.finditer(self.text, begin):
            place = found.end()
            lengths.append(place - found.start())
            counts.append(self.count(found.group()))
            while old < place - shift and old < len(self.text) - shift:
                old, b, j = self._next(b, j, old)
            if old == place - shift and place - shift >= end:
                break
        if place >= len(self.text) or not lengths:
            b, j = max(0, len(self.tree.counts) - 1), len(self.tree.counts[-1]) if self.tree.counts else 0
        self.encoded += len(counts)
        self.tree.replace((a, i), (b, j), lengths, counts)

    def _next(self, b: int, j: int, start: int) -> tuple[int, int, int]:
        """Start, block and position of the piece behind the one at (b, j)."""
        blocks = self.tree.lengths
        if j >= len(blocks[b]):
            return start, b, j
        start += blocks[b][j]
        j += 1
        if j == len(blocks[b]) and b + 1 < len(blocks):
            b, j = b + 1, 0
        return start, b, j


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def piece_counter(ranks: bytes, pattern: str) -> tuple[regex.Pattern, Callable[[str], int]]:
    return once(("piece counter", ranks, pattern), lambda: _piece_counter(ranks, pattern))


def _piece_counter(ranks: bytes, pattern: str) -> tuple[regex.Pattern, Callable[[str], int]]:
    """The compiled pattern, and a function that counts a piece's tokens and remembers pieces it has seen."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    encoding = tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=table, special_tokens={})
    memo: dict[str, int] = {}

    def count(piece: str) -> int:
        found = memo.get(piece)
        if found is None:
            if len(memo) >= MEMO_PIECES:
                memo.clear()
            found = memo[piece] = len(encoding.encode_ordinary(piece))
        return found

    return regex.compile(pattern), count


def _shipped(spark: SparkSession, path: str | None, pattern: str | None, look_ahead: int | None):
    if pattern is not None and look_ahead is None:
        raise ValueError("A pattern of one's own needs its look_ahead")
    with open(path or default_path(), "rb") as file:
        ranks = file.read()
    given = LOOK_AHEAD if look_ahead is None else look_ahead
    return spark.sparkContext.broadcast((ranks, default_pattern() if pattern is None else pattern, given))


class _Rows:
    """Finished rows, handed on as one batch, and what they are counted with."""

    def __init__(self, schema: pa.Schema, ranks: bytes, pattern: str, ahead: int):
        self.schema, self.rows, self.pieces = schema, [], 0
        self.counting, self.ahead = piece_counter(ranks, pattern), ahead

    def add(self, at: int, counter: Counter, *figures: int) -> None:
        tree = counter.tree
        counts = np.fromiter(chain.from_iterable(tree.counts), np.int32)
        lengths = np.fromiter(chain.from_iterable(tree.lengths), np.int32)
        sizes = np.fromiter((len(block) for block in tree.counts), np.int32)
        self.rows.append((at, counter.text, counter.total(), len(counts), *figures, lengths, counts, sizes, tree.sums()))
        self.pieces += len(counts)

    def batch(self, keys: pa.Array) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True))
        taken = keys.take(pa.array(columns[0], pa.int64()))
        out = [taken, *(pa.array(c, f.type) for c, f in zip(columns[1:], list(self.schema)[1:], strict=True))]
        self.rows, self.pieces = [], 0
        return pa.RecordBatch.from_arrays(out, [f.name for f in self.schema])


def _mapped(
    narrow: DataFrame, shipped: Broadcast, figures: list[str], work: Callable[[pa.RecordBatch, int, _Rows], None]
) -> DataFrame:
    """Rows with trees: ``work`` adds the row at a place of a batch; ``figures`` are whole numbers beside those of a tree."""
    names = ["n_tokens", "n_pieces", *figures]
    schema = T.StructType(
        [
            narrow.schema["key"],
            T.StructField("text", T.StringType()),
            *(T.StructField(n, T.LongType()) for n in names),
            *T.StructType.fromDDL(TREE),
        ]
    )
    kinds = [("text", pa.string()), *((n, pa.int64()) for n in names)]
    kinds += [("lengths", _INTS), ("counts", _INTS), ("sizes", _INTS), ("sums", _SUMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows(pa.schema([("key", batch.column(0).type), *kinds]), *shipped.value)
            for at in range(batch.num_rows):
                work(batch, at, rows)
                if rows.pieces >= FLUSH_PIECES:
                    yield rows.batch(batch.column(0))
            if rows.rows:
                yield rows.batch(batch.column(0))

    small_batches(narrow.sparkSession)
    return narrow.mapInArrow(run, schema)


def trees(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    pattern: str | None = None,
    look_ahead: int | None = None,
) -> DataFrame:
    """``key, text, n_tokens, n_pieces`` and the columns of ``TREE`` for every row, to be kept.

    Null texts count as empty; rows with equal keys have a tree each; an empty table gives none. A ``pattern`` of one's own needs
    ``look_ahead``: the greatest number of characters behind the end of a piece that it may look at. It must not look before
    the start of a piece. One that leaves characters out is an error of the job.
    """
    shipped = _shipped(docs.sparkSession, path, pattern, look_ahead)

    def work(batch: pa.RecordBatch, at: int, rows: _Rows) -> None:
        rows.add(at, Counter(batch.column(1)[at].as_py(), *rows.counting, look_ahead=rows.ahead))

    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return _mapped(narrow, shipped, [], work)


def edited(
    kept: DataFrame, edits: Column, path: str | None = None, pattern: str | None = None, look_ahead: int | None = None
) -> DataFrame:
    """The trees after ``edits``, in the form of ``trees``, with ``n_before``, ``n_pieces_before`` (tokens, pieces) and ``n_encoded``.

    ``edits`` is a column of type ``EDITS`` over ``kept``, applied in order; places are in code points of the text as the earlier
    edits left it, null fields count as 0 or the empty text, a null array or edit as none. What lies outside the text is left
    out. ``n_encoded`` are the pieces encoded because of edits; no other piece is cut or encoded. The other arguments must
    be those of ``trees``.
    """
    shipped = _shipped(kept.sparkSession, path, pattern, look_ahead)
    leaves = ("lengths", "counts", "sizes")

    def work(batch: pa.RecordBatch, at: int, rows: _Rows) -> None:
        found = [batch.column(2 + i)[at].values.to_numpy().tolist() for i in range(len(leaves))]
        tree = Tree.kept(*found, batch.column(5)[at].as_py())
        counter = Counter(batch.column(1)[at].as_py(), *rows.counting, tree, rows.ahead)
        before = counter.total(), len(found[1])
        for step in batch.column(6)[at].as_py() or ():
            if step is not None:
                counter.edit(step["start"] or 0, step["length"] or 0, step["text"] or "")
        rows.add(at, counter, *before, counter.encoded)

    narrow = kept.select("key", "text", *leaves, "sums", edits.cast(EDITS).alias("edits"))
    return _mapped(narrow, shipped, ["n_before", "n_pieces_before", "n_encoded"], work)


KEPT = ("key", "text", "n_tokens", "n_pieces", "lengths", "counts", "sizes", "sums")


def save(found: DataFrame, folder: str, version: int = 0) -> None:
    """Keep trees in a folder all executors can reach, as one version of it."""
    found.select(*KEPT).write.option("compression", "zstd").parquet(f"{folder}/version={version}")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The trees of a folder as its updates left them: of every key the rows of its newest version."""
    rows = spark.read.parquet(folder)
    newer = rows.filter("version > 0").groupBy(F.col("key").alias("_key")).agg(F.max("version").alias("_version"))
    replaced = F.col("key").eqNullSafe(F.col("_key")) & (F.col("version") < F.col("_version"))
    return rows.join(by_rows(newer), replaced, "left_anti").select(*KEPT)


def update(spark: SparkSession, folder: str, edits: DataFrame, **tokenizer) -> DataFrame:
    """Apply ``(key, edits)`` to the trees of a folder, and give ``key, n_before, n_tokens, n_encoded`` of the edited rows.

    Only trees of documents with edits are read by tasks and written, as the folder's next version; files of earlier ones stay.
    A null key means the rows without one; keys that the folder lacks have no effect. Two rows with the same key are an error.
    """
    asked = edits.select(F.col("key").alias("_key"), F.col("edits").cast(EDITS).alias("_edits"))
    if not asked.groupBy("_key").count().filter("count > 1").isEmpty():
        raise ValueError("Edits of a document must be in one row")
    version = spark.read.parquet(folder).agg(F.max("version")).first()[0]
    rows = current(spark, folder).join(asked, F.col("key").eqNullSafe(F.col("_key")))
    path = f"{folder}/version={version + 1}"
    after = edited(rows, F.col("_edits"), **tokenizer)
    # n_before and n_encoded are of this version alone, so a reader of all versions doesn't see them.
    after.select(*KEPT, "n_before", "n_encoded").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).select("key", "n_before", "n_tokens", "n_encoded")
