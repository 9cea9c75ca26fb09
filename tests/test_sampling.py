import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import sample


@pytest.fixture(scope="module")
def affinity(spark):
    rng = random.Random(1)
    rows = [(i % 7 if i % 3 else 0, f"d{i}", rng.choice([0.1, 0.5, rng.random()])) for i in range(900)]
    return spark.createDataFrame(rows, "cluster long, docid string, cos double").repartition(6).cache()


@pytest.fixture(scope="module")
def quota(spark):
    return spark.createDataFrame([(c, c * 4 + 1) for c in range(6)] + [(6, 10_000)], "cluster long, quota long")


def exploded(affinity, quota, seeds):
    """Every document once a draw, in Python."""
    keys = affinity.select("cluster", "docid", *[(F.col("cos") - F.log(-F.log(sample.uniform(F.col("docid"), s)))).alias(f"k{s}") for s in seeds]).collect()
    most, out = {r.cluster: r.quota for r in quota.collect()}, set()
    for c, q in most.items():
        for s in seeds:
            own = sorted((r for r in keys if r.cluster == c), key=lambda r: (-r[f"k{s}"], r.docid))
            out |= {(c, r.docid, q) for r in own[:q]}
    return out


@pytest.mark.parametrize("size", [1, 50, 10**6])
def test_sketches_give_the_pool_of_full_draws(affinity, quota, monkeypatch, size):
    monkeypatch.setattr(sample, "SKETCH_ROWS", size)
    got = sample.pool(affinity, quota)
    assert {tuple(r) for r in got.collect()} == exploded(affinity, quota, sample.DRAW_SEEDS)


def test_a_task_sends_its_best_alone(spark, affinity, quota):
    few = quota.where("cluster < 6")
    own = affinity.join(few, "cluster").select("cluster", "docid", "quota", F.array(F.col("cos"), -F.col("cos")).alias("keys")).coalesce(1)
    sent = sample.sketches(own, 2)
    assert sent.count() == 2 * few.agg(F.sum("quota")).first()[0]
    assert sample.sketches(own.limit(0), 2).count() == 0


def plain_mmr(vecs, sim, names, count, lam):
    unit = vecs / np.sqrt((vecs * vecs).sum(1, keepdims=True))
    left, picks, out = list(range(len(names))), [], []
    while left and len(picks) <= count:
        score = {i: lam * sim[i] - ((1 - lam) * max(float(unit[i] @ unit[p]) for p in picks) if picks else 0) for i in left}
        best = min(left, key=lambda i: (-round(score[i], 12), names[i]))
        picks.append(best)
        left.remove(best)
        out.append((best, score[best]))
    return [i for i, _ in sorted(out, key=lambda x: (-round(x[1], 12), names[x[0]]))[:count]]


def test_the_lazy_queue_picks_what_a_plain_loop_picks():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 60):
        for lam in (0.0, 0.3, 0.5, 0.9):
            vecs = rng.standard_normal((n, 4))
            vecs[n // 2 :] = vecs[: n - n // 2]  # repeated vectors: ties
            sim, names = np.round(rng.random(n), 1), [f"n{i:02}" for i in rng.permutation(n)]
            for count in (0, 1, 3, n, n + 5):
                got = sample.mmr_order(vecs, sim, names, count, lam)
                assert [i for i, _ in got] == plain_mmr(vecs, sim, names, count, lam)


def test_a_bound_of_quotas_is_a_limit_before_the_shuffle(spark, affinity, quota):
    similar = affinity.join(quota.where("cluster < 6"), "cluster").withColumnRenamed("cos", "sim")
    limited = sample.diversified(similar, 1.0, 30)
    assert sorted(map(tuple, limited.collect())) == sorted(map(tuple, sample.diversified(similar, 1.0).collect()))
    assert "WindowGroupLimit" in limited._jdf.queryExecution().executedPlan().toString()


def test_the_flagship_has_the_limit(spark, sf):
    from rankloom.plans.queries import documents_to_annotate

    assert "WindowGroupLimit" in documents_to_annotate(spark, sf)._jdf.queryExecution().executedPlan().toString()
