import numpy as np
import pytest

from rankloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x int, vec int, d int, n int, i int, v int"


def made(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, 3, 4, 5, 6) for i, v in rows], SCHEMA)


def brute(vectors, k=8):
    """By the whole covariance and a dense solver."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    e, w = np.linalg.eigh(centred.T @ centred / n)
    e, w = e[::-1], w[:, ::-1]
    k = int((e[:k] > 1e-12 * e.sum()).sum())
    return n, ((n * x - sums) ** 2).sum(1), centred @ w[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("d,spread", [(64, 1.0), (64, 0.97), (256, 0.95), (300, 0.995), (3, 0.5)])
def test_leading_pairs(d, spread):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = spread ** np.arange(d) if spread < 1 else np.r_[np.full(5, 2.0), np.linspace(1, 0.5, d - 5)]  # five equal ones
    v, passes = (q * values) @ q.T, []
    e, x, residual = whitening.leading(lambda b: passes.append(b.shape[1]) or v @ b, d)
    k = min(8, d)
    assert np.allclose(e, values[:k], rtol=1e-12) and np.allclose(x.T @ x, np.eye(k), atol=1e-12)
    assert residual.max() <= whitening.RESIDUAL * e[0] and np.abs(v @ x - x * e).max() <= 2 * whitening.RESIDUAL * e[0]
    assert max(passes) <= 3 * whitening.BLOCK


def test_uncertified_is_an_error():
    rng = np.random.default_rng(0)
    v = np.cov(rng.standard_normal((400, 300)).T)
    with pytest.raises(ArithmeticError):
        whitening.leading(lambda b: v @ b, 300, passes=3)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    rows.sort(key=lambda r: r[0])
    n, deviation, white, explained = brute([v for _, v in rows])
    got = whitening.whitened(df).orderBy("vec_id", "component").toPandas()
    assert got.n.eq(n).all() and got.deviation.to_numpy().reshape(-1, 8)[:, 0].tolist() == deviation.tolist()
    found = got.whitened.to_numpy().reshape(-1, 8)
    assert np.abs(found * np.sign((found * white).sum(0)) - white).max() < 1e-8
    assert np.allclose(got.explained.to_numpy().reshape(-1, 8)[0], explained, rtol=1e-10) and got.identity_error.max() < 1e-10 and got.identity_error.nunique() == 1


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.standard_normal(12)) for i in range(40)]
    rows = [*good, (3, good[3][1]), (3, rng.standard_normal(12)), (None, rng.standard_normal(12))]
    bad = [(50, None), (51, []), (52, [1.0] * 5), (53, [float("nan")] * 12), (54, [None] * 12), (55, [float("inf")] + [0.0] * 11), (56, [1.0] * 13)]
    got = whitening.whitened(made(spark, rows + bad)).toPandas()
    n, deviation, white, explained = brute([v for _, v in rows])
    assert n == 43 and got.n.eq(43).all() and len(got) == 43 * 8
    key = lambda i: -1 if i is None or i != i else int(i)
    assert sorted(zip(map(key, got.vec_id), got.deviation)) == sorted((key(i), int(x)) for (i, _), x in zip(rows, deviation) for _ in range(8))
    assert sorted(map(key, got.vec_id[got.component == 1])) == sorted(key(i) for i, _ in rows)
    for c in range(8):
        assert np.allclose(np.sort(np.abs(got.whitened[got.component == c + 1])), np.sort(np.abs(white[:, c])), atol=1e-9)


def test_without_variance(spark):
    assert whitening.whitened(made(spark, [])).count() == 0
    assert whitening.whitened(made(spark, [(1, None)])).count() == 0
    assert whitening.whitened(made(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(made(spark, [(i, [0.5, 0.25, 1.0]) for i in range(6)])).count() == 0
    line = whitening.whitened(made(spark, [(i, [i, 2 * i, 0.0]) for i in range(6)])).collect()  # rank one
    assert len(line) == 6 and {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_wide_whole_numbers():
    sums = np.array([10**17, 5])
    assert whitening._exact(np.array([[10**5, 3]]), 10**15, sums).tolist() == [[10**20 - 10**17, 3 * 10**15 - 5]]
