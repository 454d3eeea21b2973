import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import vptree
from ticketlens.llm.queries import op3_nearest


def _brute(rows, asks, k):
    good = {
        i: np.array(v, float)
        for i, v in rows
        if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))
    }
    out = {}
    for q in good:
        if asks(q):
            scores = sorted((-float((good[q] * v).cumsum()[-1]), i) for i, v in good.items() if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def _found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def _rows(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, d))
    return [(int(i), [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("shard_rows", [64, 100_000])
def test_factor_one_is_exact(spark, shard_rows):
    rows = _rows(700, 6, 1)
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # many equal vectors, ties by id
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = _found(vptree.nearest(table, F.col("vec_id") % 20 == 0, 20, 1.0, shard_rows=shard_rows, sample_rows=200))
    want = _brute(rows, lambda i: i % 20 == 0, 20)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q, v in want.items():
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in v], abs=1e-12)


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 0.0]),
        (20, [0.0, 0.0]),
        (40, None),
        (60, [float("nan"), 1.0]),
        (80, [float("inf"), 1.0]),
        (1, [None, 1.0]),
        (2, [0.5, 0.5]),
        (3, [0.5, 0.5]),
        (4, [1.0, 2.0, 3.0]),
        (None, [1.0, 1.0]),
        (5, []),
        (100, [2.0, -1.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS leaf", "2 AS id", "3 AS v")
    found = _found(vptree.nearest(table, F.col("vec_id") % 20 == 0))
    assert found == {0: [(100, 2.0), (2, 0.5), (3, 0.5)], 100: [(0, 2.0), (2, 0.5), (3, 0.5)]}
    assert vptree.nearest(table.limit(0), F.lit(True)).collect() == []
    one = table.filter("vec_id = 0")
    assert vptree.nearest(one, F.lit(True)).collect() == []


def test_query_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = _brute(rows, lambda i: i % 20 == 0, 20)
    found = _found(op3_nearest(spark, sf_dir))
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    truth = dict(rows)
    for q, v in found.items():
        assert [s for _, s in v] == pytest.approx([np.dot(np.array(truth[q], float), np.array(truth[i], float)) for i, _ in v])


def test_repeated_rows_leave_room_for_other_ids(spark):
    rows = _rows(120, 6, 3)
    rows += [(1001, rows[7][1])] * 30 + [(1001 + i, rows[7][1]) for i in range(1, 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = _found(vptree.nearest(table, F.col("vec_id") % 20 == 7, 5, 1.0, shard_rows=64, sample_rows=8))
    want = _brute(dict(rows).items(), lambda i: i % 20 == 7, 5)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}


@pytest.mark.parametrize(("spread", "norm"), [(1e-9, 1.0), (1e-9, 1000.0), (1e-7, 1.0), (1e-3, 1.0)])
def test_factor_one_is_exact_for_nearly_equal_vectors(spread, norm):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16))
    x = centres[rng.integers(0, 8, 3_000)]
    x = x / np.linalg.norm(x, axis=1, keepdims=True) + spread * rng.normal(size=x.shape)
    x = norm * x / np.linalg.norm(x, axis=1, keepdims=True)
    ids, k = np.arange(len(x)), 20
    space = vptree.Space(float(np.sqrt((x**2).sum(axis=1).max())))
    tree = vptree.build(space.lifted(x), ids, 64, np.random.default_rng(1))
    queries = x[::50]
    best = vptree.Nearest.none(len(queries), k)
    vptree.search(tree, space, x, ids, queries, ids[::50], best, np.full(len(queries), np.inf), 1.0)
    for q, (own, found) in enumerate(zip(ids[::50], best.ids, strict=True)):
        score = vptree.products(queries, x, np.full(len(x), q), ids)
        score[own] = -np.inf
        assert found.tolist() == np.lexsort((ids, -score))[:k].tolist()


@pytest.mark.parametrize("factor", [1.0, 4.0, 50.0])
def test_no_query_has_fewer_than_it_can(spark, factor):
    rows = _rows(900, 6, 4)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = _found(vptree.nearest(table, F.col("vec_id") % 20 == 0, 20, factor, shard_rows=64, sample_rows=200))
    assert len(found) == 45 and {len(v) for v in found.values()} == {20}


def test_a_common_vector_is_cut_before_the_shuffle(spark):
    table = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [float(i + 1), 1.0]) for i in range(600)], "vec_id long, embedding array<double>")
    rows = table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).distinct()
    numbered = rows.withColumn("place", F.row_number().over(vptree.Window.partitionBy("v").orderBy("id"))).filter("place <= 21")
    assert "WindowGroupLimit" in numbered._jdf.queryExecution().executedPlan().toString()
    found = _found(vptree.nearest(table, F.col("vec_id") % 50 == 0, 20, 1.0, shard_rows=64, sample_rows=100))
    want = _brute(((r["vec_id"], r["embedding"]) for r in table.collect()), lambda i: i % 50 == 0, 20)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}
