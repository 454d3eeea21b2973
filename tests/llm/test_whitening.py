import numpy as np
import pytest

from ticketlens.llm import whitening
from ticketlens.llm.queries import op11_whitening


def _fit_rows(rows):
    good = [(i, v) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all()]
    lengths = [len(v) for _, v in good]
    size = max(set(lengths), key=lambda s: (lengths.count(s), s)) if lengths else 0
    good = [(i, v) for i, v in good if len(v) == size]
    return [i for i, _ in good], np.floor(1024.0 * np.array([v for _, v in good], float).reshape(len(good), size)).astype(np.int64) + 100_000


def _check(found, rows, components=8):
    """Against an eigendecomposition of the whole covariance, exact whole sums and the definition's figures."""
    ids, x = _fit_rows(rows)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    covariance = centred.T @ centred / n
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    assert len(found) == n * k
    table = {}
    for r in found:
        assert r["n"] == n
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(covariance), rel=1e-9)
        assert r["identity_error"] < 1e-9
        table.setdefault(r["component"], []).append(r)
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    for c in range(k):
        got = sorted((r["vec_id"] is None, r["vec_id"], r["deviation"], r["whitened"]) for r in table[c + 1])
        want = centred @ v[:, c] / np.sqrt(e[c])
        signs = []
        pairs = sorted((i is None, i, d, w) for i, d, w in zip(ids, exact, want, strict=True))
        assert [g[:3] for g in got] == [p[:3] for p in pairs]
        if min(abs(e[c] - np.delete(e, c)), default=1) > 1e-4 * e[0]:
            top = max(range(n), key=lambda i: abs(pairs[i][3]))
            signs = np.sign(pairs[top][3] * got[top][3])
            assert np.array([g[3] for g in got]) * signs == pytest.approx([p[3] for p in pairs], abs=1e-8)


def _table(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("key", "x", "n", "component", "sums", "size", "count"):
        frame = frame.selectExpr("*", f"'a' AS {name}")
    return frame


def _collect(frame):
    return frame.withColumnRenamed("key", "vec_id").collect()


@pytest.mark.parametrize(("n", "size", "parts"), [(400, 12, 7), (30, 12, 3), (5, 12, 2), (90, 3, 40)])
def test_equals_whole_eigendecomposition(spark, n, size, parts):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, size)) * np.geomspace(1, 0.05, size) @ np.linalg.qr(rng.normal(size=(size, size)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = whitening.whitened(_table(spark, rows).repartition(parts))
    _check(_collect(found), rows)


def test_equal_vectors_and_ties(spark):
    rng = np.random.default_rng(3)
    # Most rows are one vector, and two directions have equal variance.
    rows = [(7, [0.5, 0.5, 0.5, 0.5])] * 300 + [(i, v) for i in range(4) for v in ([1.0, 0.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, -1.0, 0.0, 0.0])]
    rows += [(None, [float(c) for c in v]) for v in rng.integers(-3, 4, (3, 4))]
    _check(_collect(whitening.whitened(_table(spark, rows).repartition(6))), rows)


def test_awkward_vectors(spark):
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [1.0, 2.0, 3.0])]
    rows = [*odd, (7, [1.0, 2.0]), (8, [2.0, -1.0]), (None, [0.5, 0.25]), (8, [2.0, -1.0])]
    _check(_collect(whitening.whitened(_table(spark, rows))), rows)
    for none in (odd[:5], [], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(_table(spark, none)).collect() == []


def _scatter(x):
    return (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))


def test_updates_alone_follow_the_scatter_matrix():
    rng = np.random.default_rng(5)
    x = rng.integers(-500, 500, (300, 16)) * np.r_[np.ones(8), np.full(8, 30)].astype(int)
    x[100:150] = x[99]
    a, b = whitening.Spectrum.empty(16), whitening.Spectrum.empty(16)
    for row in x[:200]:
        a.add(row)
    for row in x[200:]:
        b.add(row)
    for found, want in ((a, _scatter(x[:200])), (b, _scatter(x[200:]))):
        assert np.abs(found.basis.T @ found.basis - np.eye(16)).max() < 1e-10
        assert np.abs(found.basis * found.values @ found.basis.T - want).max() < 1e-9 * np.abs(want).max()
    a.join(b)
    assert a.n == 300 and (a.sums == x.sum(axis=0)).all()
    assert np.abs(a.basis * a.values @ a.basis.T - _scatter(x)).max() < 1e-9 * np.abs(_scatter(x)).max()


@pytest.mark.parametrize("seed", range(6))
def test_secular_roots(seed):
    rng = np.random.default_rng(seed)
    n = [1, 2, 5, 40, 64, 64][seed]
    poles = np.sort(rng.random(n)) if seed < 5 else np.cumsum(10.0 ** rng.integers(-9, 3, n))
    weights, rho = 10.0 ** -rng.integers(0, 8, n).astype(float), 2.5
    origin, distance = whitening.secular_roots(poles, weights, rho)
    z = np.sqrt(weights)
    want = np.linalg.eigvalsh(np.diag(poles) + rho * np.outer(z, z))
    assert poles[origin] + distance == pytest.approx(want, abs=1e-12 * want[-1])
    roots = poles[origin] + distance
    assert (roots >= poles).all() and (roots[:-1] <= poles[1:]).all()


def test_sums_of_squares_are_exact():
    rows = np.array([[3, 4], [2**40, 1], [2**31, 1], [2**31 + 1, -(2**30)]])
    assert whitening._squared_lengths(rows) == [25, None, 2**62 + 1, (2**31 + 1) ** 2 + 2**60]


def test_query_over_the_whole_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = op11_whitening(spark, sf_dir)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    _check(found.collect(), rows)
