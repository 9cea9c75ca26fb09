import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import toxicity

from .conftest import made


def corpus(n=700, seed=5):
    """Toxic if an insult and a group stand in one text; either alone is clean."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(3, 40))]
        kind = i % 4
        words += ["rotter"] * (kind in (0, 1)) + ["newcomers"] * (kind in (0, 2))
        rng.shuffle(words)
        rows.append((i, " ".join(words).replace("rotter", rng.choice(["rotter", "Rotter!", "ROTTER"])), "s"))
        labels.append((i, int(kind == 0)))
    return rows, labels


def test_interactions_are_learnt(spark):
    rows, labels = corpus()
    docs, marks = made(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(docs, marks).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) >= 0.95


def test_pairs_equal_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(0.3, np.arange(9, dtype=np.uint64), rng.normal(size=9), rng.normal(size=(9, 4)))
    at = np.array([0, 2, 3, 7])
    z = 0.3 + m.weights[at].sum() + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(at) for b in at[:i])
    assert abs(m.score(at) - 1 / (1 + np.exp(-z))) < 1e-12


def test_odd_rows_and_labels(spark, odd, none):
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40)] + [(3, 1, 0), (None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, toxic int, score int")
    out = toxicity.report(odd, marks)
    assert out.count() == odd.count() and out.where(F.col("score").isNull()).count() == 0
    assert toxicity.report(none, marks).count() == 0
    empty = toxicity.report(odd, marks.limit(0)).collect()
    assert len({r.score for r in empty}) == 1
    ones = toxicity.report(odd, marks.where("toxic = 1"))
    assert ones.select("score").distinct().count() == 1 and ones.where("predicted = 0").count() == 0
    assert toxicity.clean(odd, marks.where("toxic = 0")).columns == odd.columns
    assert toxicity.clean(odd, marks.where("toxic = 0")).count() == odd.count()


def test_held_out_accuracy(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.report(docs, marks).join(marks, "doc_id").where("held_out").select((F.col("predicted") == F.col("toxic")).alias("right")).collect()
    assert sum(r.right for r in got) / len(got) >= 0.9


def test_pairs_that_tell_only_together(spark):
    """Toxic where both words stand or neither: neither says anything by itself."""
    rng, rows, labels = random.Random(11), [], []
    for i in range(1500):
        both = [w for w in ("rotter", "newcomers") if rng.random() < 0.5]
        words = [f"w{rng.randrange(200)}" for _ in range(25)] + both
        rng.shuffle(words)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(len(both) != 1)))
    docs, marks = made(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(docs, marks).collect()}
    held = [got[i].predicted == y for i, y in labels if got[i].held_out]
    assert sum(held) / len(held) >= 0.98


def test_contrast_equals_four_shares():
    rng = np.random.default_rng(2)
    a, b, y = (rng.random((400, k)) < 0.4 for k in (3, 5, 1))
    a, b, y = a.astype(np.float32), b.astype(np.float32), y[:, 0].astype(np.float32)
    got = toxicity.contrast(a, b, y)
    for i in range(3):
        for j in range(5):
            cells = [(s, y[(a[:, i] == u) & (b[:, j] == v)]) for s, u, v in ((1, 1, 1), (-1, 1, 0), (-1, 0, 1), (1, 0, 0))]
            p = [(s, (c.sum() + 0.5) / (len(c) + 1), len(c) + 1) for s, c in cells]
            assert abs(got[i, j] - sum(s * q for s, q, _ in p) / sum(q * (1 - q) / n for _, q, n in p) ** 0.5) < 1e-4
