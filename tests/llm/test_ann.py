import numpy as np
import pytest

from rankloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0.1, 1) for i, v in rows], SCHEMA)


def brute(vecs, query, k):
    a = vecs[query]
    same = [(i, v) for i, v in vecs.items() if i != query and len(v) == len(a)]
    score = {i: float(a @ v / (np.linalg.norm(a) * np.linalg.norm(v))) for i, v in same}
    return sorted(score, key=lambda i: (-round(score[i], 12), i))[:k], score


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).astype(np.float32)) for i in range(1500)]
    vectors = ann.usable(table(spark, rows)).cache()
    vecs = {i: v.astype(float) for i, v in rows}
    got = {}
    for r in ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5, shard=400, query_block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        best, score = brute(vecs, q, 5)
        hits += len({v for _, v, _ in found} & set(best))
        assert [n for n, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in found)
    assert len(got) == 30 and hits / 150 >= 0.9


def test_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    hot = rng.normal(size=4).astype(np.float32)
    rows = [(i, hot) for i in range(100, 400)] + [(i, rng.normal(size=4).astype(np.float32)) for i in range(400, 500)]
    rows += [(1, None), (2, [0, 0, 0, 0]), (3, [1, None, 0, 0]), (4, [float("nan"), 1, 1, 1]), (5, [float("inf"), 1, 1, 1]), (None, hot), (100, hot), (7, [1, 2]), (8, [2, 4]), (9, [])]
    vectors = ann.usable(table(spark, rows)).cache()
    got = {}
    for r in ann.nearest(vectors, vectors.where("vec_id % 50 = 0 or vec_id = 7"), 5, shard=64).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert [got[100][i] for i in range(1, 6)] == [101, 102, 103, 104, 105]
    assert [got[150][i] for i in range(1, 6)] == [100, 101, 102, 103, 104]
    assert got[7] == {1: 8}
    assert not {1, 2, 3, 4, 5, 9} & {v for x in got.values() for v in x.values()}


def test_empty(spark):
    vectors = ann.usable(table(spark, []))
    assert ann.nearest(vectors, vectors, 5).count() == 0


def test_graph_survives_packing():
    rng = np.random.default_rng(2)
    mat = rng.normal(size=(300, 8))
    shard = ann.build(np.arange(300), mat)
    again = ann.unpacked(ann.packed(shard), mat)
    assert all(np.array_equal(a, b) for x in ("nodes", "graph") for a, b in zip(shard[x], again[x], strict=True))
    one = ann.build(np.array([5]), mat[:1])
    assert ann.search(one, ann.unit(mat[:2]).astype(np.float32), 3).tolist() == [[0, -1, -1]] * 2


@pytest.mark.parametrize("d", [64, 256])
def test_recall_over_full_shards(d):
    """Queries from outside of three shards of the size that is used, vectors without any structure."""
    rng = np.random.default_rng(d)
    shards, q = [rng.standard_normal((ann.SHARD, d)) for _ in range(3)], rng.standard_normal((60, d))
    unit = ann.unit(q).astype(np.float32)
    scores = np.concatenate([unit @ ann.unit(x).astype(np.float32).T for x in shards], axis=1)
    want = np.argsort(-scores, axis=1)[:, :5]
    found = []
    for i, x in enumerate(shards):
        ids = np.arange(ann.SHARD) + i * ann.SHARD
        block = {"mat": q, "vec_id": -1 - np.arange(len(q))}
        found.append(ann._best(block, ids, np.arange(1, ann.SHARD + 1), np.arange(ann.SHARD), x, ann.build(ids, x), 5, ann.BEAM).to_pandas())
    import pandas as pd

    best = pd.concat(found).sort_values(["query_id", "score"], ascending=[True, False]).groupby("query_id").head(5)
    got = best.groupby("query_id").vec_id.apply(set)
    assert np.mean([len(got[-1 - i] & set(w.tolist())) / 5 for i, w in enumerate(want)]) >= 0.93
