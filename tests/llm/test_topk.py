import numpy as np
import pytest

from rankloom.llm import topk
from rankloom.llm.common import vectors_of

from .test_ann import table


def brute(vecs, query, k):
    score = {i: int(vecs[query] @ v) for i, v in vecs.items() if i != query and len(v) == len(vecs[query])}
    return [(i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:k]]


@pytest.mark.parametrize(("size", "scale"), [(8, 1.0), (3, 0.05), (5, 3e4)])
def test_equals_brute_force(spark, size, scale):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=size) * scale).astype(np.float32)) for i in range(300)] + [(i, np.full(size, scale, np.float32)) for i in range(300, 400)]
    vectors = vectors_of(table(spark, rows)).cache()
    vecs = {i: np.floor(64 * v.astype(float)).astype(object) for i, v in rows}
    got = {}
    for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20, scale=64, bins=16, block=90, query_block=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 400, 20):
        assert [x[1:] for x in sorted(got[q])] == brute(vecs, q, 20)


def test_odd_rows(spark):
    rows = [(20, [0.5, -0.5]), (21, [1.0, 1.0]), (22, None), (23, [None, 1.0]), (24, [float("nan"), 1.0]), (25, [0.25]), (40, [0.1]), (20, [0.9, 0.9]), (20, [0.5, -0.5]), (60, []), (None, [1.0, 1.0])]
    vectors = vectors_of(table(spark, rows))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20, scale=64).collect())
    assert got == [(20, 1, 21, 0), (40, 1, 25, 6 * 16)]
    empty = vectors_of(table(spark, []))
    assert topk.top_k(empty, empty, 20).count() == 0


def whole(x):
    n, d = float(x).as_integer_ratio()
    return 64 * n // d


def big_table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("high", [21, 27, 40, 53])
def test_large_components_are_exact(spark, high):
    rng = np.random.default_rng(high)
    rows = [(i, [float(rng.normal()), float(rng.normal()) * 2.0 ** (high if i % 3 == 0 else 2), 0.0]) for i in range(120)]
    # no product of two large components fits a long beyond 2^31 each: their counterparts are zero there
    if high > 25:
        rows = [(i, [v[0], v[1] if i % 3 == 0 else 0.0, 0.0] if i % 20 else [v[0], 0.0, v[2]]) for i, v in rows]
    vecs = {i: [whole(x) for x in v] for i, v in rows}
    vectors = vectors_of(big_table(spark, rows))
    got = {}
    for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 5, scale=64, block=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 120, 20):
        score = {i: sum(a * b for a, b in zip(v, vecs[q], strict=True)) for i, v in vecs.items() if i != q}
        assert [x[1:] for x in sorted(got[q])] == [(i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:5]]


def test_large_query_and_scores_beyond_a_long(spark):
    rows = [(20, [3e6, 0]), (21, [1, 1]), (22, [2, 1]), (40, [1, 1])]
    vectors = vectors_of(big_table(spark, rows))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20, scale=64).collect())
    assert got == [(20, 1, 22, 192_000_000 * 128), (20, 2, 21, 192_000_000 * 64), (20, 3, 40, 192_000_000 * 64), (40, 1, 20, 192_000_000 * 64), (40, 2, 22, 64 * 192), (40, 3, 21, 64 * 128)]
    # far below: not among the two highest, so no error; among them: an error, never a missing row
    rows = [(20, [1e300, 1]), (21, [-1e300, 1]), (22, [0, 1]), (23, [0, 2])]
    vectors = vectors_of(big_table(spark, rows))
    query = vectors.where("vec_id = 20")
    assert sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, query, 2, scale=64).collect()) == [(1, 23, 64 * 128), (2, 22, 64 * 64)]
    with pytest.raises(Exception, match="no long can hold"):
        topk.top_k(vectors, query, 3, scale=64).collect()
