import hashlib

import numpy as np
import pytest

from ticketlens.llm import centroids
from ticketlens.llm.queries import op12_centroids


def _brute(rows, clusters=8, rounds=10, size=64):
    """Every round from scratch, in Python's whole numbers."""
    kept = [(i, [int(np.floor(1024.0 * float(c))) for c in v]) for i, v in rows if v and len(v) == size and None not in v and np.isfinite(np.array(v, float)).all()]
    name = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=name)[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        for c, members in groups.items():
            centres[c] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    out = [(i, nearest(v), far(v, centres[nearest(v)])) for i, v in kept]
    inertia = {}
    for _, c, d in out:
        inertia[c] = inertia.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in out), key=repr)


def _found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def _rows(n, size, seed, groups=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, size))
    x = middle[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, size))
    return [(int(i), [float(c) for c in v.astype(np.float32)]) for i, v in enumerate(x)]


@pytest.mark.parametrize("rounds", [0, 1, 10])
def test_equals_clustering_from_scratch(spark, rounds):
    rows = _rows(300, 6, 1)
    rows += [(1000 + i, rows[9][1]) for i in range(120)] + [(3, rows[4][1]), (3, rows[5][1]), (None, rows[6][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = centroids.described(centroids.clustered(table, rounds=rounds, size=6))
    assert _found(got) == _brute(rows, rounds=rounds, size=6)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    # Two distinct vectors only: six centroids are copies of others and stay empty.
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = _found(centroids.described(centroids.clustered(table, size=2)))
    assert got == _brute(rows, size=2)
    assert len({r[1] for r in got}) == 2


def test_awkward_vectors(spark):
    rows = [
        (1, None),
        (2, []),
        (3, [1.0, None]),
        (4, [float("nan"), 0.0]),
        (5, [float("-inf"), 0.0]),
        (6, [1.0, 2.0, 3.0]),
        (None, [0.25, -0.0001]),
        (8, [0.0, 0.0]),
        (8, [0.0, 0.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("key", "x", "dots", "cluster", "distance", "n", "hash"):
        table = table.selectExpr("*", f"'a' AS {name}")
    assert _found(centroids.described(centroids.clustered(table, size=2))) == _brute(rows, size=2)
    assert centroids.described(centroids.clustered(table.limit(0), size=2)).collect() == []
    large = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(large, size=2)


def test_products_are_updated_by_changed_components_only(spark):
    rows = _rows(50, 4, 2)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    state = centroids.whole_vectors(table, 4, "vec_id", "embedding").selectExpr("*", "array(7L, -7L) AS dots")
    old = np.array([[1, 2, 3, 4], [5, 6, 7, 8]])
    new = np.array([[1, 2, 5, 4], [5, 6, 7, 8]])
    for r in centroids._moved(state, old, new).collect():
        assert list(r["dots"]) == [7 + 2 * r["x"][2], -7]


def test_query_over_the_whole_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert _found(op12_centroids(spark, sf_dir)) == _brute(rows)
