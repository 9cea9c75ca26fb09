import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import stem as S
from rankloom.operators import cluster, ivf, kmeans, lexical, retrieve

# ---- k-means -------------------------------------------------------------------------------------------------------


def plain_lloyd(x, c, rounds):
    c = c.copy()
    near = lambda: np.array([((row - c) ** 2).sum(1).argmin() for row in x])
    for _ in range(rounds):
        at, new = near(), c.copy()
        for j in set(at.tolist()):
            new[j] = x[at == j].mean(0)
        if np.array_equal(new, c):
            break
        c = new
    at = near()
    cosine = (x * c[at]).sum(1) / np.sqrt((x * x).sum(1) * (c[at] ** 2).sum(1))
    return ((x - c[at]) ** 2).sum(), ((1 - cosine) ** 2).sum()


def vecs(spark, x):
    return spark.createDataFrame([(str(i), row.tolist()) for i, row in enumerate(x)], "docid string, embedding array<double>")


def points(df):
    return df.select(F.col("embedding").alias("vec"))


def test_problems_share_their_scans_and_equal_plain_runs(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 8)) + 3 * rng.standard_normal((12, 8))[rng.integers(0, 12, 600)]
    df = vecs(spark, x).repartition(5).cache()
    start = kmeans.starts(df, 150, 3)
    assert np.array_equal(start[:20], kmeans.starts(df, 20, 3))
    scans = []
    scan, kmeans._scan = kmeans._scan, lambda *a: scans.append(1) or scan(*a)
    try:
        fits = kmeans.lloyd(points(df), [kmeans.Problem(start[:k]) for k in (1, 5, 40, 150)] + [kmeans.Problem(start[:7, 2:5], 2, 5)], 9)
    finally:
        kmeans._scan = scan
    for k, fit in zip((1, 5, 40, 150), fits):
        assert np.allclose((fit.sse, fit.cosine_sse), plain_lloyd(x, start[:k], 9))
    assert np.allclose(fits[4].sse, plain_lloyd(x[:, 2:5], start[:7, 2:5], 9)[0])
    assert len(scans) == max(f.scans for f in fits) + 1 <= 10
    assert fits[3].distances < 600 * 150 * (fits[3].scans + 1) * 0.8  # the bounds skip some


def test_grouped_nearest_is_exact():
    rng = np.random.default_rng(2)
    for k, d in ((65, 2), (400, 3), (1000, 16)):
        c, x = rng.standard_normal((k, d)), rng.standard_normal((500, d))
        c[7] = c[3]  # ties go to the smaller number
        x[0] = c[3]
        want = ((x[:, None] - c[None]) ** 2).sum(2)
        got = kmeans.Grouped(c).nearest(x)
        assert np.allclose(want[np.arange(500), got], want.min(1)) and got[0] in (3, 7)


@pytest.mark.parametrize("scale", [1.0, 1e-22, 1e25, 1e100])
def test_nearest_without_clusters_takes_each_distance_once_and_is_exact(scale):
    rng = np.random.default_rng(4)
    c, x = rng.standard_normal((900, 24)) * scale, rng.standard_normal((3000, 24)) * scale
    c[500], c[7] = c[3] * (1 + 1e-9), c[3]  # nearer to one another than single precision tells
    x[:100] = c[3] * (1 + np.linspace(-1e-6, 1e-6, 100))[:, None]
    grouped = kmeans.Grouped(c)
    got = grouped.nearest(x)
    want = kmeans._squared(x, (x * x).sum(1), c, (c * c).sum(1))
    assert np.array_equal(got, want.argmin(1)) and not grouped.groups and grouped.single.dtype == np.float32
    assert grouped.counted < 3000 * 900 * (1.2 if scale == 1.0 else 2.2)


def test_one_centroid_and_one_vector():
    assert kmeans.Grouped(np.ones((1, 3))).nearest(np.zeros((2, 3))).tolist() == [0, 0]
    assert kmeans.Grouped(np.zeros((2, 3))).nearest(np.ones((1, 3))).tolist() == [0]


def test_sweep_uses_every_core_for_a_file_that_is_one_task(spark, monkeypatch):
    x = np.random.default_rng(5).standard_normal((80, 4))
    df, parts, scan = vecs(spark, x).coalesce(1), [], kmeans._scan
    monkeypatch.setattr(kmeans, "_scan", lambda v, *a: parts.append(v.rdd.getNumPartitions()) or scan(v, *a))
    curve = cluster.elbow_curve(df, (5, 70), iterations=3).collect()
    begin = kmeans.starts(df, 70, cluster.ELBOW_SEED)
    assert set(parts) == {spark.sparkContext.defaultParallelism}
    assert np.allclose([r.sse for r in curve], [plain_lloyd(x, begin[:k], 3)[1] for k in (5, 70)])


def test_elbow_curve_saves_every_k(spark):
    rng = np.random.default_rng(3)
    df, seen = vecs(spark, rng.standard_normal((60, 4))), []
    curve = cluster.elbow_curve(df, (5, 10, 50, 100), iterations=4, save=lambda c: seen.append(c.count())).collect()
    assert [r.k for r in curve] == [5, 10, 50] and seen == [1, 2, 3] and curve[0].sse > curve[2].sse
    assert cluster.elbow_curve(df.limit(3), (5, 10)).count() == 0


# ---- inverted file -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def token_rows():
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((30, 16))
    docs = {f"d{i:03}": middles[rng.integers(0, 30, rng.integers(1, 9))] + 0.3 * rng.standard_normal((1, 16)) for i in range(300)}
    asked = {f"q{i}": middles[rng.integers(0, 30, 5)] + 0.2 * rng.standard_normal((5, 16)) for i in range(12)}
    return docs, asked


@pytest.fixture(scope="module")
def index(spark, token_rows, tmp_path_factory):
    docs, asked = token_rows
    path = str(tmp_path_factory.mktemp("ivf") / "index")
    tokens = spark.createDataFrame([(d, p, v.tolist()) for d, m in docs.items() for p, v in enumerate(m)] + [("bad", 0, None), ("bad", 1, [float("nan")] * 16)], "docid string, pos int, dvec array<double>")
    ivf.build(tokens, path, 20, rounds=5)
    return path, spark.createDataFrame([(q, p, v.tolist()) for q, m in asked.items() for p, v in enumerate(m)], "qid string, qpos int, qvec array<double>")


def brute(docs, asked, k):
    out = {}
    for q, m in asked.items():
        scores = {d: -((m[:, None] - np.float32(t).astype(float)[None]) ** 2).sum(2).min(1).sum() for d, t in docs.items()}
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_every_token_is_coded_once(spark, index, token_rows):
    path, _ = index
    codes = spark.read.parquet(f"{path}/codes")
    assert sorted(map(tuple, codes.select("docid", "pos").collect())) == sorted((d, p) for d, m in token_rows[0].items() for p in range(len(m)))
    assert ivf.sizes(spark, path).agg(F.sum("n")).first()[0] == codes.count()
    stored = {r.docid: r for r in ivf.documents(spark, path).collect()}
    assert set(stored) == set(token_rows[0])
    assert all(np.allclose(stored[d].tokens, m, atol=1e-6) and stored[d].n_tokens == len(m) for d, m in token_rows[0].items())


def test_search_with_few_probes_finds_what_scoring_everything_finds(spark, index, token_rows, tmp_path):
    path, asked = index
    want = brute(*token_rows, 20)
    got = ivf.search(spark, path, asked, str(tmp_path / "p"), 20, probes=5, depth=60).collect()
    found = {(r.qid, r.docid): r.score for r in got}
    exact = {(q, d): s for q, m in brute(*token_rows, 10**6).items() for d, s in m}
    assert all(abs(s - exact[key]) < 1e-9 for key, s in found.items())  # scores are of the whole documents
    hits = sum((q, d) in found for q, m in want.items() for d, _ in m)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert {r.rank for r in got if r.qid == "q0"} == set(range(1, 21))


def test_all_probes_and_depth_are_exact(spark, index, token_rows, tmp_path):
    path, asked = index
    want = {(q, d, i + 1) for q, m in brute(*token_rows, 20).items() for i, (d, _) in enumerate(m)}
    got = ivf.search(spark, path, asked, str(tmp_path / "p"), 20, probes=99, depth=10**6)
    assert {(r.qid, r.docid, r.rank) for r in got.collect()} == want


def test_only_probed_partitions_are_read(spark, index):
    path, asked = index
    probes = asked.where("qid = 'q0'").select("qid", (F.length("qid") + 1).cast("long").alias("cluster"))
    codes = ivf.probed_codes(spark, path, probes)
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert {r.cluster for r in codes.select("cluster").distinct().collect()} <= {3}
    few = codes.select(F.input_file_name().alias("f")).distinct().count()
    assert few < spark.read.parquet(f"{path}/codes").select(F.input_file_name().alias("f")).distinct().count()


def test_parts_and_blocks_change_nothing(spark, index, token_rows, tmp_path, monkeypatch):
    docs, _ = token_rows
    path, asked = index
    want = sorted(map(tuple, ivf.search(spark, path, asked, str(tmp_path / "a"), 10, 6, 40).collect()))
    monkeypatch.setattr(ivf, "PART_ROWS", 8)
    monkeypatch.setattr(ivf, "QUERY_ROWS", 3)
    monkeypatch.setattr(ivf, "AT_ONCE", 2)
    tokens = spark.createDataFrame([(d, p, v.tolist()) for d, m in docs.items() for p, v in enumerate(m)], "docid string, pos int, dvec array<double>")
    again = str(tmp_path / "index")
    ivf.build(tokens, again, 20, rounds=5)
    assert ivf.sizes(spark, again).agg(F.max("parts")).first()[0] > 1
    assert sorted(map(tuple, ivf.search(spark, again, asked, str(tmp_path / "b"), 10, 6, 40).collect())) == want


def test_mask(spark):
    rows = spark.createDataFrame([("a", 0, "word"), ("a", 1, "?!"), ("a", 2, "x."), ("a", 3, None), ("a", 300, "late"), ("b", 0, "—")], "docid string, pos int, token string")
    assert sorted(r.token for r in ivf.kept(rows).collect()) == ["word", "x.", "—"]


# ---- stems and lexical index ---------------------------------------------------------------------------------------

# Words and their stems, as the algorithm's description gives them.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
generalizations gener oscillators oscil adhesion adhes action action by by yes ye""".split()


def test_stems():
    for word, want in zip(STEMS[::2], STEMS[1::2], strict=True):
        assert S.stem(word) == want, word


def test_analyzers(spark):
    rows = spark.createDataFrame([("The cats' owner's running, isn't O'Neil’s!",), ("",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(S.plain(F.col("t")), S.english(F.col("t"))).collect()]
    assert got == [(["the", "cats", "owner", "s", "running", "isn", "t", "o", "neil", "s"], ["cat", "owner", "run", "isn", "t", "o", "neil"]), ([], []), (None, None)]


def test_lengths_of_one_byte(spark):
    got = {r.id: r.q for r in spark.range(5000).select("id", lexical.quantized(F.col("id")).alias("q")).collect()}
    assert all(got[i] == i for i in range(41)) and got[41] == 40 and got[57] == 56 and got[1000] == 984
    assert all(got[i] <= i < got[i] * 1.13 + 1 and got[i] <= got[i + 1] for i in range(4999))


@pytest.mark.parametrize("k,per_range", [(3, 4), (10, 64), (500, 8)])
def test_search_equals_scoring_everything(spark, tmp_path, k, per_range, monkeypatch):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(200)]
    text = lambda n: " ".join(words[min(199, int(rng.expovariate(1 / 30)))] for _ in range(n))
    docs = spark.createDataFrame([(f"d{i}", text(rng.randrange(0, 60)) if i % 17 else None, text(3)) for i in range(400)], "docid string, body string, head string").cache()
    topics = spark.createDataFrame([(f"q{i}", text(rng.randrange(1, 9))) for i in range(15)] + [("none", "zzz"), ("empty", ""), ("null", None)], "qid string, qtext string")
    monkeypatch.setattr(lexical, "RANGE", per_range)
    lexical.build(docs, path := str(tmp_path / "i"), ["body", "head"], per_range=per_range, slices=4)
    search = lexical.Search(topics, path, {"body": 1.0, "head": 0.5}, str(tmp_path / "s"), k=k, digits=6)
    got = sorted(map(tuple, search.run().collect()))
    want = retrieve.bm25_top(topics, docs, {"body": 1.0, "head": 0.5}, k, 6)
    assert got == sorted(map(tuple, want.collect()))
    reads = search.reads().first()
    assert reads.scored <= reads.of_terms
    if k == 3:
        assert reads.scored < 0.9 * reads.of_terms  # blocks that can't matter stay unread
    assert "dynamicpruning" in lexical.postings(spark, path, search.asked)._jdf.queryExecution().executedPlan().toString()
