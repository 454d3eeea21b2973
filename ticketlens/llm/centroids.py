"""Clustering around centroids in whole numbers, with the distance matrix kept and updated in place.

A vector's squared distance to a centroid is |x|^2 - 2 x.c + |c|^2. The products x.c are exact integers and are
kept per vector in a stored table, one per centroid. When a centroid moves, only the components that changed matter:
each product grows by the sum of x[j] times the change of c[j], over the components j with a change other than zero. The
argmin is then taken anew from the kept products. A round reads the stored state, writes the next one, and adds up the vectors per
cluster by partial sums; the driver holds the centroids alone. When no centroid moves, further rounds change nothing
and are left out.

States are written tables, so a lost executor costs the tasks it held; the state before the last is deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.session import discard, shared_folder, staged

SCALE = 1024
CLUSTERS, ROUNDS, SEED = 8, 10, 3
# Largest whole component: 2**26 squared, times 64 components and a factor of four, stays within 63 bits.
LARGEST = 1 << 26


def unfit(vector: Column) -> Column:
    """Whether a vector is null or holds null or non-finite components."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(odd, F.lit(True))


def whole(vector: Column, scale: int = SCALE) -> Column:
    """Components times ``scale`` as doubles, rounded down."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def whole_vectors(table: DataFrame, size: int, key: str, vector: str) -> DataFrame:
    """``(key, x)``: vectors of exactly ``size`` finite components as whole numbers; other rows go."""
    fit = table.filter((F.size(vector) == size) & ~unfit(F.col(vector)))
    x = F.transform(
        whole(F.col(vector)),
        lambda c: F.when(F.abs(c) > LARGEST, F.raise_error(F.lit(f"A component times {SCALE} is beyond {LARGEST}")).cast("long")).otherwise(c).cast("int"),
    )
    return fit.select(F.col(key).alias("key"), x.alias("x"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """Vectors with the smallest hash of seed and key; equal hashes (repeated keys) by their components."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(named.cast("binary"), 256).alias("hash"), "x").orderBy("hash", "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], np.int64)


@dataclass
class Clustering:
    """Final centroids, one a row, and ``vectors``: ``(key, x, dots, cluster, distance)``."""

    centroids: np.ndarray
    vectors: DataFrame


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32)), pa.array(values.reshape(-1)))


def _moved(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The state after the centroids moved from ``old`` to ``new``: products updated by the changes, argmin taken anew."""
    change = new - old
    parts = [(c, np.flatnonzero(change[c])) for c in range(len(new)) if change[c].any()]
    lengths = (new * new).sum(axis=1)
    size = new.shape[1]
    schema = T.StructType(
        [
            state.schema["key"],
            T.StructField("x", T.ArrayType(T.IntegerType(), False)),
            T.StructField("dots", T.ArrayType(T.LongType(), False)),
            T.StructField("cluster", T.IntegerType()),
            T.StructField("distance", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), size).astype(np.int64)
            dots = _matrix(batch.column(2), len(new)).copy()
            for c, at in parts:
                dots[:, c] += x[:, at] @ change[c, at]
            far = lengths - 2 * dots
            cluster = far.argmin(axis=1)  # the first of equals
            distance = far[np.arange(len(x)), cluster] + (x * x).sum(axis=1)
            columns = [batch.column(0), batch.column(1), _lists(dots), pa.array(cluster, pa.int32()), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return state.select("key", "x", "dots").mapInArrow(run, schema)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Rounded-down means of the vectors of each cluster; a cluster without vectors keeps its centroid."""
    sums = [F.sum(F.get("x", F.lit(j))).alias(f"s{j}") for j in range(centroids.shape[1])]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(centroids.shape[1])]
    return out


def clustered(
    table: DataFrame,
    *,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    size: int = 64,
    seed: int = SEED,
    key: str = "vec_id",
    vector: str = "embedding",
) -> Clustering:
    """Assign every fit vector of ``table`` to one of ``clusters`` centroids after ``rounds`` rounds.

    Null vectors, vectors of another length and those with null or non-finite components take no part. Keys may
    repeat (each row counts; equal hashes are ordered by components) or be null (hashed as the empty text). With fewer fit
    vectors than clusters there are as many centroids as vectors; without any, the result is empty. Of equally near
    centroids the smaller number wins. Components beyond ``LARGEST`` after scaling stop the job. Further columns of any name are ignored.
    """
    vectors = staged(whole_vectors(table, size, key, vector), "vectors")
    centroids = first_centroids(vectors, clusters, seed)
    spark, path = table.sparkSession, None
    before = np.zeros((len(centroids), size), np.int64)
    centroids = centroids.reshape(-1, size)
    state = vectors.withColumn("dots", F.array_repeat(F.lit(0).cast("long"), len(centroids)))
    for done in range(rounds + 1):
        following = _moved(state, before, centroids)
        last, path = path, shared_folder(spark, "clusters")
        following.write.parquet(path)
        state = spark.read.schema(following.schema).parquet(path)
        if last is not None:
            discard(last)
        if done == rounds:
            break
        before, centroids = centroids, _means(state, centroids)
        if np.array_equal(before, centroids):
            break
    return Clustering(centroids, state)


def hashed(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def described(found: Clustering) -> DataFrame:
    """``(key, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of each vector.

    Distances are added up as decimals; a sum beyond 63 bits stops the job.
    """
    sums = found.vectors.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast("long").alias("n")).collect()
    inertia = {r["cluster"]: r["n"] for r in sums}
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), hashed(v)) for c, v in enumerate(found.centroids)]
    spark = found.vectors.sparkSession
    names = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.vectors.select("key", "cluster", "distance").join(F.broadcast(names), "cluster").select(
        "key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
