"""Nearest neighbours by inner product, with a vantage-point tree in every shard.

Vectors are lifted to one more dimension so that all have the same norm; the order of inner products is then
the order of Euclidean distances, for which the triangle inequality holds. A tree over a bounded sample
deals the vectors to shards, one leaf each (large leaves are split by hash), and every shard gets a tree of its
own. A query visits the shards, and in a shard the nodes, that the triangle inequality doesn't rule out: a node
whose least possible distance, times ``factor``, exceeds the distance of the query's k-th nearest so
far. Factor one restores exact search. The sample's own k-th nearest bounds the distance from the
start, so that shards are ruled out before rows are sent to them; these neighbours count as found.

Within a leaf, a matrix product rules out what can't reach a query's k-th score by more than its rounding error; the
others are scored exactly. Distances from scores are bounds that include the rounding of their squares, so that factor
one is exact for vectors that differ by little.

Of equal vectors only the k + 1 with the smallest ids are indexed: no more can be among k nearest.
Scores are sums of products in double precision, added in the same order for every pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.session import staged

SAMPLE_ROWS = 4096  # vectors that the dealing tree is fitted on
SHARD_ROWS = 16_384  # vectors in a shard, about
LEAF_ROWS = 256
FACTOR = 1.5
QUERY_BLOCK = 512


def _rounding(components: int) -> float:
    """Bound on the relative error of sums of so many products, with room for the terms beside them."""
    return 8 * (components + 8) * float(np.finfo(np.float64).eps)


@dataclass
class Node:
    """Vectors within ``radius`` of ``point`` are inside; a leaf has ``rows`` instead."""

    point: np.ndarray | None = None
    radius: float = 0.0
    inside: Node | None = None
    outside: Node | None = None
    rows: np.ndarray | None = None


def _distance(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - point) ** 2).sum(axis=-1), 0))


def build(points: np.ndarray, rows: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Node:
    """A tree over ``points[rows]``; what can't be split stays one leaf."""
    if len(rows) <= leaf_rows:
        return Node(rows=rows)
    # Of a few candidates, the one whose distances spread the most.
    tried = rng.choice(rows, min(8, len(rows)), replace=False)
    some = rng.choice(rows, min(128, len(rows)), replace=False)
    point = points[tried[np.argmax([_distance(points[some], points[t]).std() for t in tried])]]
    far = _distance(points[rows], point)
    radius = float(np.median(far))
    inside = far <= radius
    if inside.all():
        inside = far < radius
        radius = float(far[inside].max()) if inside.any() else radius
    if not inside.any():
        return Node(rows=rows)
    return Node(
        point, radius, build(points, rows[inside], leaf_rows, rng), build(points, rows[~inside], leaf_rows, rng)
    )


def leaves(node: Node) -> list[Node]:
    return [node] if node.rows is not None else leaves(node.inside) + leaves(node.outside)


@dataclass
class Nearest:
    """The k best of each query so far: scores from high to low, then ids from low to high."""

    score: np.ndarray
    ids: np.ndarray

    @classmethod
    def none(cls, queries: int, k: int) -> Nearest:
        return cls(np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max))

    def offer(self, at: np.ndarray, queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Candidates ``ids`` with their ``vectors`` for the queries at ``at``, whose own ids are left out."""
        k = self.score.shape[1]
        about = queries @ vectors.T
        error = _rounding(vectors.shape[1]) * np.sqrt((queries**2).sum(axis=1) * (vectors**2).sum(axis=1).max(initial=0.0))
        which, candidate = np.nonzero((about >= (self.score[at, -1] - error)[:, None]) & (own[:, None] != ids[None]))
        if not len(which):
            return
        score = products(queries, vectors, which, candidate)
        # The touched queries' k so far and their new candidates, ordered by query.
        touched = np.unique(which)
        row = np.concatenate([np.repeat(touched, k), which])
        all_scores = np.concatenate([self.score[at[touched]].ravel(), score])
        all_ids = np.concatenate([self.ids[at[touched]].ravel(), ids[candidate]])
        order = np.lexsort((all_ids, -all_scores, row))
        starts = np.searchsorted(row[order], touched)
        best = order[starts[:, None] + np.arange(k)]
        self.score[at[touched]], self.ids[at[touched]] = all_scores[best], all_ids[best]


def products(queries: np.ndarray, vectors: np.ndarray, which: np.ndarray, candidate: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, each summed in order of the components, whatever stands beside it."""
    out = np.zeros(len(which))
    for d in range(queries.shape[1]):
        out += queries[which, d] * vectors[candidate, d]
    return out


@dataclass
class Space:
    """The lift: ``norm`` is the largest norm of all vectors."""

    norm: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0))
        return np.concatenate([vectors, rest[:, None]], axis=1)

    @staticmethod
    def query(vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1)

    def reach(self, queries: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Most that a lifted vector with at least this score is away from its query; infinite for no score.

        The square of the distance is known up to a share of the squared norms, so its root is off by
        far more where it is small.
        """
        total = (queries**2).sum(axis=1) + self.norm**2
        error = _rounding(queries.shape[1])
        square = np.where(np.isfinite(score), np.maximum(total - 2 * score, 0), np.inf)
        return np.sqrt(square + error * total) + error * np.sqrt(total)


def _bounds(node: Node, queries: np.ndarray, least: np.ndarray, out: list[np.ndarray]) -> None:
    """Least distance of each query to anything in each leaf, leaves in order."""
    if node.rows is not None:
        out.append(least)
        return
    d = _distance(queries, node.point)
    _bounds(node.inside, queries, np.maximum(least, d - node.radius), out)
    _bounds(node.outside, queries, np.maximum(least, node.radius - d), out)


def _place(node: Node, points: np.ndarray, rows: np.ndarray, out: np.ndarray, number: list[int]) -> None:
    if node.rows is not None:
        out[rows] = number[0]
        number[0] += 1
        return
    inside = _distance(points[rows], node.point) <= node.radius
    _place(node.inside, points, rows[inside], out, number)
    _place(node.outside, points, rows[~inside], out, number)


def search(
    node: Node,
    space: Space,
    vectors: np.ndarray,
    ids: np.ndarray,
    queries: np.ndarray,
    own: np.ndarray,
    best: Nearest,
    reach: np.ndarray,
    factor: float,
) -> None:
    """Offer to ``best`` what a tree holds for a block of queries, whose own ids are left out.

    ``reach`` is an upper bound of each query's k-th distance, known beforehand.
    """
    lifted = space.query(queries)

    def visit(node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.rows is not None:
            best.offer(at, queries[at], own[at], vectors[node.rows], ids[node.rows])
            return
        d = _distance(lifted[at], node.point)
        near_inside = d <= node.radius
        for first, side, other in ((near_inside, node.inside, node.outside), (~near_inside, node.outside, node.inside)):
            visit(side, at[first])
            late = at[first]
            limit = np.minimum(reach[late], space.reach(queries[late], best.score[late, -1]))
            visit(other, late[np.abs(d[first] - node.radius) * factor <= limit])

    visit(node, np.arange(len(queries)))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(
    table: DataFrame,
    queries: Column,
    k: int = 20,
    factor: float = FACTOR,
    key: str = "vec_id",
    vector: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row that ``queries`` selects.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    with a null id, nor vectors whose length isn't the most common one. A row is no neighbour of its own id.
    Ties go to the smaller id. With fewer candidates than ``k``, all are returned.
    """
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(
        F.count("*").alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square")
    )
    common = sizes.orderBy(F.col("rows").desc(), "size").first()
    if common is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == common["size"])
    space = Space(float(np.sqrt(common["square"])))

    # The dealing tree, from a bounded sample, and what the sample says about each query's k-th neighbour.
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("id", "v").toArrow()
    sample_ids = sample.column(0).to_numpy()
    sample_vectors = _matrix(sample.column(1).combine_chunks())
    lifted = space.lifted(sample_vectors)
    shards = -(-common["rows"] // shard_rows)
    top = build(lifted, np.arange(len(lifted)), max(1, -(-len(lifted) // max(shards, 1))), np.random.default_rng(11))
    # Distinct ids only, so that the k-th is a bound for k different neighbours.
    _, once = np.unique(sample_ids, return_index=True)
    few = once[: max(4 * k, 512)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = space.lifted(_matrix(batch.column(1)))
            at = np.zeros(len(points), np.int32)
            _place(top, points, np.arange(len(points)), at, [0])
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], ["leaf", "id", "v"])

    # Of equal vectors the k + 1 smallest ids, each once, however often its row repeats. Rows are made distinct by id and vector
    # first; of a common vector, each task then sends on k + 1 rows only.
    equal = Window.partitionBy("v").orderBy("id")
    numbered = rows.select("id", "v").distinct().withColumn("place", F.row_number().over(equal))
    indexed = numbered.filter(F.col("place") <= k + 1).select("id", "v")
    dealt = staged(indexed.mapInArrow(deal, "leaf int, id long, v array<double>"), "dealt")
    counts = staged(dealt.groupBy("leaf").agg(F.count("*").alias("rows")), "leaves")
    splits = counts.withColumn("splits", F.ceil(F.col("rows") / (2 * shard_rows))).select("leaf", "splits")

    def first(part: np.ndarray, own: np.ndarray) -> Nearest:
        best = Nearest.none(len(part), k)
        best.offer(np.arange(len(part)), part, own, sample_vectors[few], sample_ids[few])
        return best

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            asked = _matrix(batch.column(1)) if len(ids) else np.zeros((0, common["size"]))
            for low in range(0, len(ids), QUERY_BLOCK):
                yield asked[low : low + QUERY_BLOCK], ids[low : low + QUERY_BLOCK]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in blocks(batches):
            yield listed(own, first(part, own))

    def listed(own: np.ndarray, best: Nearest) -> pa.RecordBatch:
        which, place = np.nonzero(np.isfinite(best.score))
        columns = [pa.array(own[which]), pa.array(best.ids[which, place]), pa.array(best.score[which, place])]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in blocks(batches):
            reach = space.reach(part, first(part, own).score[:, -1])
            bounds: list[np.ndarray] = []
            _bounds(top, space.query(part), np.zeros(len(part)), bounds)
            leaf, at = np.nonzero(np.stack(bounds) * factor <= reach)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf.astype(np.int32)), pa.array(own[at]), pa.array(list(part[at]), pa.list_(pa.float64())), pa.array(reach[at])],
                ["leaf", "id", "v", "reach"],
            )

    queried = rows.filter("asks").select("id", "v")
    asked = queried.mapInArrow(ask, "leaf int, id long, v array<double>, reach double")
    asked = asked.join(splits, "leaf").select("leaf", F.explode(F.expr("sequence(0L, splits - 1)")).alias("part"), F.lit(1).alias("kind"), "id", "v", "reach")
    held = dealt.join(splits, "leaf").select("leaf", F.pmod(F.xxhash64("id"), "splits").alias("part"), F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("reach"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        tree = vectors = ids = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard_of = batch.column(0).to_numpy() * 1_000_003 + batch.column(1).to_numpy()
            kind = batch.column(2).to_numpy()
            mark = np.flatnonzero(np.r_[True, (shard_of[1:] != shard_of[:-1]) | (kind[1:] != kind[:-1])])
            for low, high in zip(mark, [*mark[1:], len(kind)], strict=True):
                piece = batch.slice(low, high - low)
                if shard_of[low] != shard:
                    shard, parts, tree = shard_of[low], [], None
                if kind[low] == 0:
                    parts.append((piece.column(3).to_numpy(), _matrix(piece.column(4))))
                    continue
                if tree is None:
                    if not parts:
                        continue
                    ids, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
                    tree = build(space.lifted(vectors), np.arange(len(ids)), LEAF_ROWS, np.random.default_rng(13))
                own, asked_for, reach = piece.column(3).to_numpy(), _matrix(piece.column(4)), piece.column(5).to_numpy()
                for at in range(0, len(own), QUERY_BLOCK):
                    block = slice(at, at + QUERY_BLOCK)
                    best = Nearest.none(len(own[block]), k)
                    search(tree, space, vectors, ids, asked_for[block], own[block], best, reach[block], factor)
                    yield listed(own[block], best)

    found = (
        held.unionByName(asked)
        .repartition("leaf", "part")
        .sortWithinPartitions("leaf", "part", "kind", "id")
        .mapInArrow(answer, "query_id long, vec_id long, score double")
    )
    found = found.unionByName(queried.mapInArrow(begin, found.schema))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
