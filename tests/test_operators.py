import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import vector as V
from rankloom.operators import cluster, corpus, evaluate, mine, models, retrieve, sample
from rankloom.sources import files
from rankloom.streaming import queries as streaming


def sizes(spark, rows):
    return spark.createDataFrame([(i, s, i) for i, s in enumerate(rows)], "cluster long, size long, first_seen long")


@pytest.mark.parametrize(("given", "train", "quota"), [([5, 5, 5], 3, [1, 1, 1]), ([60, 30, 10], 13, [7, 4, 2]), ([4, 4], 4, [2, 2]), ([1, 99], 20, [1, 19]), ([3, 3, 3], 5, [1, 2, 2]), ([2, 2], 100, [2, 2])])
def test_quotas(spark, given, train, quota):
    got = {r.cluster: r.quota for r in cluster.quotas(sizes(spark, given), train).collect()}
    assert [got[i] for i in range(len(given))] == quota


def test_quota_edges(spark):
    with pytest.raises(ValueError):
        cluster.quotas(sizes(spark, [3, 3, 3]), 2)
    got = cluster.quotas(sizes(spark, [4, 4]), 4, compat=True).collect()
    assert sorted(r.quota for r in got) == [3, 3]


def vectors(spark, rows):
    return spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(rows)], "docid string, embedding array<float>")


def test_assignment_and_nearest(spark):
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(200, 8)).astype(np.float32), rng.normal(size=(7, 8))
    cents = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster long, centroid array<double>")
    d = ((x[:, None].astype(float) - c[None]) ** 2).sum(2)
    got = {int(r.docid): r for r in cluster.assigned(vectors(spark, x), cents).collect()}
    assert [got[i].cluster for i in range(200)] == d.argmin(1).tolist()
    near = {r.cluster: int(r.docid) for r in cluster.nearest_documents(vectors(spark, x), cents).collect()}
    assert [near[i] for i in range(7)] == d.argmin(0).tolist()


def test_softmax_sums_to_one(spark):
    rows = spark.createDataFrame([(i % 3, str(i), i / 30 - 0.4) for i in range(30)], "cluster long, docid string, cos double")
    got = cluster.softmax(rows).groupBy("cluster").agg(F.sum("p")).collect()
    assert all(abs(r[1] - 1) < 1e-12 for r in got)


def test_pool_is_bounded_and_repeats(spark):
    rows = spark.createDataFrame([(i % 4, str(i), (i % 7) / 7) for i in range(100)], "cluster long, docid string, cos double")
    quota = spark.createDataFrame([(0, 5), (1, 25), (2, 1), (3, 3)], "cluster long, quota long")
    one, two = (sorted(map(tuple, sample.pool(rows, quota).collect())) for _ in range(2))
    assert one == two
    n = {c: sum(r[0] == c for r in one) for c in range(4)}
    assert n[1] == 25 and all(q <= n[c] <= 5 * q for c, q in ((0, 5), (2, 1), (3, 3)))


def greedy(vecs, sim, names, count, lam):
    """All picks, then sorted by the score they had."""
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    left, taken, out = set(range(len(names))), [], []
    while left:
        score = {i: lam * sim[i] - (1 - lam) * max([unit[i] @ unit[j] for j in taken], default=0) for i in left}
        pick = min(left, key=lambda i: (-round(score[i], 12), names[i]))
        out.append((pick, score[pick]))
        taken.append(pick)
        left.remove(pick)
    return sorted(out, key=lambda x: (-round(x[1], 12), names[x[0]]))[:count]


@pytest.mark.parametrize("lam", [0.0, 0.3, 0.5, 1.0])
def test_mmr_is_exact(lam):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 12, 30):
        for _ in range(15):
            vecs, names = rng.normal(size=(n, 4)), [f"d{i}" for i in rng.permutation(n)]
            sim, count = rng.uniform(-1, 1, n), int(rng.integers(1, n + 1))
            assert [i for i, _ in sample.mmr_order(vecs, sim, names, count, lam)] == [i for i, _ in greedy(vecs, sim, names, count, lam)]


def test_mmr_one_is_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 2, f"{i}", 3, rng.normal(size=3).tolist(), float(rng.uniform())) for i in range(20)]
    similar = spark.createDataFrame(rows, "cluster long, docid string, quota long, vec array<double>, sim double")
    plain = sorted(r.docid for r in sample.diversified(similar, 1.0).collect())
    python = sorted(r.docid for r in sample.diversified(similar, 0.999999999).collect())
    assert plain == python and len(plain) == 6


@pytest.mark.parametrize(("ys", "k"), [([100, 50, 25, 20, 18, 17], 3), ([50, 40, 30, 20, 10, 0], None), ([100, 40, 20, 18, 17, 16], 3), ([100, 30, 28, 26, 24, 22], 2)])
def test_knee(spark, ys, k):
    curve = spark.createDataFrame([(i + 1, float(y)) for i, y in enumerate(ys)], "k int, sse double")
    assert cluster.knee(curve).first()[0] == k


def run_of(spark, lists):
    return spark.createDataFrame([(q, d, i + 1) for q, ds in lists.items() for i, d in enumerate(ds)], "qid string, docid string, rank int")


@pytest.mark.parametrize(("n", "plain", "compat"), [(0, 0, 0), (3, 3, 3), (4, 4, 4), (5, 5, 3), (6, 6, 2), (7, 7, 1), (8, 8, 8), (9, 8, 8), (100, 8, 8)])
def test_tail(spark, n, plain, compat):
    run = run_of(spark, {"q": [f"d{i}" for i in range(n)]})
    assert mine.tail(run).count() == plain
    assert mine.tail(run, compat=True).count() == compat


def test_hard_negatives_skip_missing_texts(spark):
    run = run_of(spark, {"q": [f"d{i:03}" for i in range(100)]})
    docs = spark.createDataFrame([(f"d{i:03}", f"t{i}") for i in range(100) if i != 93], "docid string, doctext string")
    got = mine.hard_negatives(run, docs)
    assert sorted(r["rank"] for r in got.collect()) == [93, 95, 96, 97]
    queries = spark.createDataFrame([("q", "what", "pos\tx"), ("r", "none", "p")], "qid string, qtext string, positive string")
    rows = [(r.label, r.doctext) for r in mine.reranker_rows(queries, got).collect()]
    assert sorted(rows) == [(0.0, "t92"), (0.0, "t94"), (0.0, "t95"), (0.0, "t96"), (1.0, "pos\tx")]
    assert {r.pos for r in mine.triples(queries, got).collect()} == {"pos x"}


def test_metrics(spark):
    run = run_of(spark, {"a": ["x", "y", "z"], "b": ["x"]})
    qrels = spark.createDataFrame([("a", "y", 2), ("a", "z", 1), ("a", "w", 0), ("b", "q", 0), ("c", "x", 1)], "qid string, docid string, rel int")
    got = {r.qid: r.ndcg for r in evaluate.ndcg(run, qrels).collect()}
    ideal = 2 + 1 / np.log2(3)
    assert abs(got["a"] - (2 / np.log2(3) + 1 / 2) / ideal) < 1e-12 and got["b"] == got["c"] == 0
    assert {r.qid: r.recall for r in evaluate.recall(run, qrels).collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}
    means = {r.metric: r.value for r in evaluate.metrics(run, qrels).collect()}
    assert abs(means["R@100"] - 1 / 3) < 1e-12 and 0 <= means["nDCG@10"] <= 1


def test_last_wins_and_ids(spark):
    rows = spark.createDataFrame([("a", "one", 1), ("b", "x", 2), ("a", None, 3)], "docid string, doctext string, n int")
    assert {(r.docid, r.doctext) for r in corpus.last_wins(rows, "docid", "n").collect()} == {("a", None), ("b", "x")}


def test_dense_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    q = vectors(spark, x[:20]).withColumnRenamed("docid", "qid")
    got = {}
    for r in retrieve.dense(q, vectors(spark, x), 7).collect():
        got.setdefault(int(r.qid), {})[r["rank"]] = int(r.docid)
    s = x[:20].astype(float) @ x.T.astype(float)
    for i in range(20):
        assert [got[i][k] for k in range(1, 8)] == np.argsort(-s[i], kind="stable")[:7].tolist()


def test_probing_every_partition_is_exact(spark):
    rng = np.random.default_rng(6)
    v = vectors(spark, rng.normal(size=(120, 4)))
    q = v.limit(9).withColumnRenamed("docid", "qid")
    cents = cluster.fit_centroids(v, 6, iterations=5)
    full = {(r.qid, r.docid) for r in retrieve.dense(q, v, 5).collect()}
    assert {(r.qid, r.docid) for r in retrieve.probed(q, v, cents, 5, 6).collect()} == full


def test_masked_mean():
    x = np.arange(12, dtype=float).reshape(2, 3, 2)
    got = models.masked_mean(x, np.array([[1, 1, 0], [0, 0, 0]]))
    assert got.tolist() == [[1.0, 2.0], [0.0, 0.0]]


def test_encoder_is_deterministic(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None), ("c", "x y")], "docid string, doctext string")
    got = {r.docid: r.embedding for r in models.encoded(docs).collect()}
    assert got["a"] == got["c"] and set(got["b"]) == {0.0}


def test_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"docid": 7, "doctext": "a"}\n{"docid": "x", "doctext": "b"}\n')
    assert [tuple(r) for r in files.read_corpus(spark, str(tmp_path / "c.json")).collect()] == [("7", "a"), ("x", "b")]
    (tmp_path / "t.json").write_text(json.dumps([{"qid": "1", "qtext": {"title": "q"}, "passages": [["d2", "é"], ["d1", "y"]]}]))
    flat = files.flat(files.read_test_data(spark, str(tmp_path / "t.json"))).collect()
    assert [tuple(r) for r in flat] == [("1", "q", "d2", 1, "é"), ("1", "q", "d1", 2, "y")]
    rows = spark.createDataFrame([("q\t", 'd "é"\n', 1.0), ("q", "", 0.0)], "qtext string, doctext string, label double")
    files.write_training(rows, str(tmp_path / "train"))
    assert sorted(map(tuple, files.read_training(spark, str(tmp_path / "train")).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "p.yaml").write_text('"3-shot":\n  template: |\n    Say {document}\n    Q: {query}\n')
    assert files.read_template(str(tmp_path / "p.yaml")) == "Say {document}\nQ: {query}\n"
    for n in ("checkpoint-200", "checkpoint-30", "other"):
        (tmp_path / "ck" / n).mkdir(parents=True)
    assert files.first_checkpoint(str(tmp_path / "ck")).endswith("checkpoint-30")


def test_stream_cleans_queries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"docid": str(i), "doctext": "t", "question": q}) for i, q in enumerate(["what Note: x", "é", "\n", "how"])))
    query = streaming.cleaned_to(streaming.generated_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(60)
    assert sorted(r.qtext for r in spark.read.json(str(tmp_path / "out")).collect()) == ["how", "what"]


def test_vectors_that_take_no_part(spark):
    """Null vectors, and null or non-finite components, are left out; another length is an error, never another row's numbers."""
    rows = [("a", [1.0, 2.0]), ("b", None), ("c", [3.0, 4.0]), ("d", [None, 1.0]), ("e", [float("nan"), 1.0]), ("f", [float("inf"), 1.0])]
    v = spark.createDataFrame(rows, "docid string, embedding array<double>")
    c = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 3.0])], "cluster long, centroid array<double>")
    assert {r.docid: r.cluster for r in cluster.assigned(v, c).collect()} == {"a": 0, "c": 1}
    assert {r.cluster: r.docid for r in cluster.nearest_documents(v.unionAll(spark.createDataFrame([(None, [0.0, 0.0])], v.schema)), c).collect()} == {0: "a", 1: "c"}
    q = v.withColumnRenamed("docid", "qid")
    assert {(r.qid, r.docid): r.score for r in retrieve.dense(q, v, 5).collect()} == {("a", "a"): 5, ("a", "c"): 11, ("c", "a"): 11, ("c", "c"): 25}
    assert {(r.qid, r.docid) for r in retrieve.probed(q, v, c, 5, 1).collect()} == {("a", "a"), ("c", "c")}
    odd = v.unionAll(spark.createDataFrame([("g", [1.0])], v.schema))
    for f in (lambda: cluster.assigned(odd, c), lambda: retrieve.dense(q, odd, 5)):
        with pytest.raises(Exception, match="2 components"):
            f().collect()


def test_probes_over_many_centroids(spark):
    """20,000 centroids in slices of bounded size, against all distances at once."""
    rng = np.random.default_rng(0)
    c, q = rng.normal(size=(20_000, 8)), rng.normal(size=(30, 8))
    cent = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cluster long, centroid array<double>")
    rows = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(q)], "qid string, embedding array<double>")
    got = {}
    for r in retrieve._probes(rows, cent, 32, "embedding").collect():
        got.setdefault(int(r.qid), set()).add(r.cluster)
    want = np.argsort(((q[:, None] - c[None]) ** 2).sum(2), axis=1)[:, :32]
    assert got == {i: set(w.tolist()) for i, w in enumerate(want)}


def test_recall_grows_with_probes(spark, sf):
    """Of the ten nearest: vectors without structure, 16 partitions, 4 probes, 8, and all, which are exact."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("docid"), "embedding")
    q = v.where("docid % 50 = 0").withColumnRenamed("docid", "qid")
    cent = cluster.fit_centroids(v, 16, iterations=20)
    few, half, every = ({(r.qid, r.docid) for r in retrieve.probed(q, v, cent, 10, n).collect()} for n in (4, 8, 16))
    assert every == {(r.qid, r.docid) for r in retrieve.dense(q, v, 10).collect()}
    assert 0.25 * len(every) < len(few & every) < len(half & every) <= len(every)


@pytest.mark.parametrize("block, blocks", [(3, 2), (1, 16), (100, 1)])
def test_blocks_and_passes_change_nothing(spark, sf, block, blocks, monkeypatch):
    from rankloom.plans import queries as Q

    def found():
        fields = Q.docs(spark, sf).withColumn("title", F.substring("doctext", 1, 40))
        lexical = retrieve.bm25_top(Q.topics(spark, sf).limit(11).unionAll(spark.createDataFrame([("none", "")], "qid string, qtext string")), fields, {"doctext": 1.0, "title": 0.5}, 9, 6)
        return sorted(retrieve.dense(Q.dense_queries(spark, sf), Q.vectors(spark, sf), 9, 6).collect()), sorted(lexical.collect())

    want = found()
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieve, "BLOCKS", blocks)
    monkeypatch.setattr(retrieve, "HELD", 100 * block)
    monkeypatch.setattr(retrieve, "HELD_TEXT", 10_000 * blocks)
    assert found() == want and want[0] and want[1]


def test_wrapped(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "place int, name string")
    at = spark.createDataFrame([(0,), (4,), (3,), (-1,), (None,)], "i int")
    assert {(r.i, r.name) for r in corpus.wrapped(at, rows, "i", "place").collect()} == {(0, "a"), (4, "b"), (3, "a"), (-1, "c")}
    assert corpus.wrapped(at, rows.where("false"), "i", "place").count() == 0


def test_masked_mean_column(spark):
    rows = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 6.0]], [1, 1]), (2, [[1.0, 2.0], [3.0, 6.0]], [0, 1]), (3, [[1.0, 2.0]], [0])], "i int, t array<array<double>>, m array<int>")
    assert {r.i: r.v for r in rows.select("i", V.masked_mean(F.col("t"), F.col("m")).alias("v")).collect()} == {1: [2.0, 4.0], 2: [3.0, 6.0], 3: [0.0, 0.0]}


def test_prompted_scores(spark):
    pairs = spark.createDataFrame([("q", "a", "red boat", "A red boat"), ("q", "b", "red boat", None), ("r", "a", None, "x")], "qid string, docid string, qtext string, text string")
    got = {(r.qid, r.docid): r.score for r in models.prompted_scores(pairs).collect()}
    assert got[("q", "a")] == pytest.approx(-math.log1p(math.exp(-2))) and got[("q", "b")] == pytest.approx(-2 - math.log1p(math.exp(-2))) and got[("r", "a")] == pytest.approx(-math.log(2))


def test_curve_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "curve")
    for upto in (1, 2):
        files.write_curve(spark.createDataFrame([(5, 9.0), (10, 4.0)][:upto], "k int, sse double"), path)
    assert [tuple(r) for r in files.read_curve(spark, path).orderBy("k").collect()] == [(5, 9.0), (10, 4.0)]
