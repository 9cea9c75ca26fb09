"""What grows no faster than the input: rows that plans make, and the results beside them."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import evaluate, ivf, lexical, retrieve
from rankloom.plans import queries


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _late_rows(spark, seed, width=4):
    """Documents of one to five tokens, queries of one to three, one of which has two vectors at a place."""
    rng = np.random.default_rng(seed)
    docs = [(f"d{i:02}", p, rng.normal(size=width).tolist()) for i in range(40) for p in range(1 + i % 5)]
    asked = [(f"q{i}", p, rng.normal(size=width).tolist()) for i in range(7) for p in range(1 + i % 3)] + [("q3", 0, rng.normal(size=width).tolist())]
    cents = [(i, rng.normal(size=width).tolist()) for i in range(6)]
    return docs, asked, cents


def test_late_interaction_makes_no_row_for_a_query_and_a_document(spark):
    docs, asked, cents = _late_rows(spark, 5)
    d, q, c = spark.createDataFrame(docs, "docid string, pos int, dvec array<double>"), spark.createDataFrame(asked, "qid string, qpos int, qvec array<double>"), spark.createDataFrame(cents, "cluster long, centroid array<double>")
    for probes in (1, 2, 6):
        found = retrieve.late_interaction(q, d, c, 9, probes, digits=6)
        assert "Join" not in plan(found)
        near = lambda v, n: set(np.argsort([((np.array(v) - np.array(m)) ** 2).sum() for _, m in cents], kind="stable")[:n].tolist())
        want = []
        for qid in sorted({a[0] for a in asked}):
            own = [a for a in asked if a[0] == qid]
            probed = set().union(*(near(v, probes) for _, _, v in own))
            scores = []
            for docid in sorted({x[0] for x in docs}):
                tokens = [v for i, _, v in docs if i == docid]
                if not probed & set().union(*(near(v, 1) for v in tokens)):
                    continue
                best = {}
                for _, p, v in own:
                    best[p] = max(best.get(p, -np.inf), max(-((np.array(v) - np.array(t)) ** 2).sum() for t in tokens))
                scores.append((-round(sum(best.values()), 6), docid))
            want += [(qid, docid, rank, -float(s)) for rank, (s, docid) in enumerate(sorted(scores)[:9], 1)]
        got = sorted(map(tuple, found.select("qid", "docid", "rank", "score").collect()))
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
        assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=1e-6)


def test_probed_partitions_are_products_of_matrices(spark):
    v = spark.createDataFrame([("a", [0.0, 1.0]), ("a", [0.0, 2.0]), ("b", [3.0, 0.5]), ("c", [4.0, 0.0])], "docid string, embedding array<double>")
    q = spark.createDataFrame([("x", [0.0, 1.0])], "qid string, embedding array<double>")
    c = spark.createDataFrame([(0, [0.0, 1.0]), (7, [3.0, 0.0])], "cluster long, centroid array<double>")
    found = retrieve.probed(q, v, c, 5, 2)
    assert "Join" not in plan(found)
    # an id that two vectors share is no reason to score one with the other's partition
    assert sorted((r.docid, r["rank"], r.score) for r in found.collect()) == [("a", 1, 2.0), ("a", 2, 1.0), ("b", 3, 0.5), ("c", 4, 0.0)]
    assert sorted(r.docid for r in retrieve.probed(q, v, c, 5, 1).collect()) == ["a", "a"]


def test_metrics_by_class_are_those_of_the_listed_judgments(spark):
    d = [(f"d{i:02}", i % 3 if i % 7 else None) for i in range(30)] + [("d03", 0), ("d03", 1), ("lone", 9), (None, 1)]
    docs = spark.createDataFrame(d, "docid string, label int")
    queries = docs.where("docid IN ('d00', 'd01', 'd03', 'd08', 'd11', 'lone')").withColumnRenamed("docid", "qid")
    qrels = queries.join(docs, "label").where("qid <> docid").select("qid", "docid", "label").selectExpr("qid", "docid", "1 AS rel")
    run = queries.select("qid").distinct().join(docs.select("docid").where("docid IS NOT NULL").distinct()).selectExpr("qid", "docid", "CAST(row_number() OVER (PARTITION BY qid ORDER BY md5(concat(qid, docid))) AS INT) AS rank")
    classes = evaluate.Classes(queries, docs)
    for listed, counted in ((evaluate.ndcg(run, qrels), evaluate.ndcg(run, classes)), (evaluate.recall(run, qrels, 12), evaluate.recall(run, classes, 12))):
        want, got = ({r[0]: round(r[1], 9) for r in x.collect()} for x in (listed, counted))
        assert want == got and len(want) == 4


def test_metrics_query_makes_no_row_for_a_judgment(spark, sf):
    made = plan(queries.ndcg_at_10(spark, sf)) + plan(queries.metrics_mean(spark, sf))
    assert "label#" in made and not re.search(r"Join Inner, \(\(?label", made)


def test_index_finds_documents_whose_tokens_crowd_each_other(spark, tmp_path):
    """The tokens nearest to a query token are all of two documents, yet 20 documents are wanted."""
    rng = np.random.default_rng(8)
    middles = rng.standard_normal((40, 16))
    rows = [(f"d{i:02}", p, (m + 1e-3 * rng.standard_normal(16)).tolist()) for i, m in enumerate(middles) for p in range(10)]
    tokens, asked = spark.createDataFrame(rows, "docid string, pos int, dvec array<double>"), spark.createDataFrame([("q", 0, middles[3].tolist()), ("q", 1, middles[9].tolist())], "qid string, qpos int, qvec array<double>")
    ivf.build(tokens, path := str(tmp_path / "index"), 4, rounds=3)
    got = {r.docid for r in ivf.search(spark, path, asked, str(tmp_path / "p"), 20, 4, 20).collect()}
    want = {r.docid for r in retrieve.late_interaction(asked, tokens, spark.createDataFrame([(0, [0.0] * 16)], "cluster long, centroid array<double>"), 20, 1).collect()}
    assert len(got) == 20 and len(got & want) >= 18


def test_blocks_are_made_where_documents_are_numbered():
    """A range that two batches share is one block a term, with its documents in order: no row is made for a word."""
    import pyarrow as pa

    docs = pa.table({"docid": ["a", "b", "c"], "number": [4, 5, 8], "lens": [[2], [1], [0]], "tokens": [[["x", "x"]], [["x"]], [[]]]}).to_batches(max_chunksize=1)
    got = pa.Table.from_batches(list(lexical._blocks(["f"], [1.0], 0.9, 0.4, 4)(iter(docs)))).to_pylist()
    assert [(r["term"], r["range"], r["docids"], r["n"]) for r in got] == [("x", 1, ["a", "b"], 2)]
    assert np.allclose(got[0]["weights"], [2 / (2 + 0.9 * 1.4), 1 / 1.9]) and got[0]["most"] == max(got[0]["weights"])


def test_all_bm25_scores_are_sent_by_the_task_that_has_the_document(spark, tmp_path):
    """No pair of topic and document meets in a join or an aggregate; rows of one id are one document; a word in all texts counts."""
    rows = [("a", "x y x"), ("b", "Y z"), ("a", "x, q"), ("c", None), ("d", "nothing"), (None, "z z"), ("e", "x")]
    docs = spark.createDataFrame(rows, "docid string, doctext string")
    topics = spark.createDataFrame([("1", "x z x"), ("2", "never"), ("3", "q"), ("4", None)], "qid string, qtext string")
    found = retrieve.bm25(topics, docs, folder=str(tmp_path / "all"))
    assert not re.search("Join|Aggregate", plan(found))
    words = [(i, (t or "").lower().replace(",", "").split()) for i, t in rows]
    mean = sum(len(w) for _, w in words if w) / sum(t is not None for _, t in rows)
    want = {}
    for qid, asked in (("1", {"x": 2, "z": 1}), ("3", {"q": 1})):
        for term, qtf in asked.items():
            has = {i for i, w in words if term in w}
            for i in has:
                tf, length = sum(w.count(term) for j, w in words if j == i), max(len(w) for j, w in words if j == i and term in w)
                want[qid, i] = want.get((qid, i), 0) + qtf * np.log1p((len(rows) - len(has) + 0.5) / (len(has) + 0.5)) * tf / (tf + 0.9 * (0.6 + 0.4 * length / mean))
    got = {(r.qid, r.docid): r.score for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_postings_take_few_bytes_an_entry():
    import tracemalloc

    words = [f"w{i}" for i in range(100)]
    texts, known = [" ".join(words)] * 2000, set(words)
    tracemalloc.start()
    try:
        made = retrieve._Postings([f"{i:04}" for i in range(2000)], [texts], known, [100.0], 0.9, 0.4)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(len(at) for at, _ in made.found.values()) == 200_000 and most < 30 * 200_000


def test_dense_search_lets_go_of_batches_and_takes_few_scores_at_once(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(11)
    q, x = rng.standard_normal((40, 8)).round(1), rng.standard_normal((900, 8)).round(1)
    spark.createDataFrame([(f"q{i:02}", row.tolist()) for i, row in enumerate(q)], "qid string, vec array<double>").coalesce(1).write.parquet(path := str(tmp_path / "q"))
    ids = rng.permutation(900)
    held = [pa.record_batch([pa.array([f"d{i:03}" for i in ids[lo : lo + 300]]), pa.array([x[i].tolist() for i in ids[lo : lo + 300]])], names=["docid", "vec"]) for lo in (0, 300, 600)]
    sizes, add = [], retrieve._Best._add
    monkeypatch.setattr(retrieve._Best, "_add", lambda self, scores, first: sizes.append(scores.shape[1]) or add(self, scores, first))
    monkeypatch.setattr(retrieve, "CELLS", 40 * 64)
    passed = []
    monkeypatch.setattr(retrieve, "_held", lambda against: passed.append(against))
    retrieve._scored(spark.read.parquet(path).inputFiles(), 7, 6)
    found = pa.Table.from_batches(list(passed[0](held))).to_pylist()
    assert not held and max(sizes) <= 64
    scores = np.round(q @ x.T, 6) + 0.0
    want = {(f"q{i:02}", f"d{j:03}", scores[i, j]) for i in range(40) for j in np.lexsort((np.arange(900), -scores[i]))[:7]}
    assert {(r["qid"], r["docid"], r["score"]) for r in found} == want


def test_search_keeps_less_than_all_of_a_tile_for_the_first_best(monkeypatch):
    sizes, add = [], retrieve._Best._add
    monkeypatch.setattr(retrieve._Best, "_add", lambda self, scores, first: sizes.append(scores.shape[1]) or add(self, scores, first))
    scores = np.random.default_rng(12).standard_normal((3, 4000)).round(2)
    best = retrieve._Best(3, 10)
    best.add(scores, 5)
    assert sizes[0] == 20 and sum(sizes) == 4000
    assert (best.places - 5 == [np.lexsort((np.arange(4000), -row))[:10] for row in scores]).all()


def lexical_case(seed, documents=400, topics=25):
    import random

    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(["the"] + [words[min(299, int(rng.expovariate(1 / 40)))] for _ in range(n)])
    docs = [(f"d{i}", text(rng.randrange(0, 80)) if i % 17 else None, text(3) if i % 5 else "") for i in range(documents)]
    return docs, [(f"q{i}", text(rng.randrange(1, 9))) for i in range(topics)] + [("none", "zzz"), ("empty", ""), ("null", None)]


def test_stored_search_makes_no_row_for_a_topic_and_a_range_or_document(spark, tmp_path):
    """Nothing of the texts is written but the postings, and pairs of topic and document meet in no join or sum."""
    rows, asked = lexical_case(1)
    docs, topics = spark.createDataFrame(rows, "docid string, body string, head string"), spark.createDataFrame(asked, "qid string, qtext string")
    lexical.build(docs, path := str(tmp_path / "i"), ["body", "head"], slices=4)
    search = lexical.Search(topics, path, {"body": 1.0, "head": 0.5}, scratch := str(tmp_path / "s"), k=10, digits=6)
    found = search.run()
    assert set(re.findall(r"Join \w+", plan(found))) == {"Join LeftSemi"} and "sum(" not in plan(found) and found.count() == 25 * 10
    kept = {p.name for p in [*(tmp_path / "i").iterdir(), *(tmp_path / "s").iterdir()] if p.is_dir()}
    assert kept == {"postings", "tasks", "terms", "fields", "tokens", "asked", "topics"} and spark.read.parquet(f"{scratch}/topics").count() == 25
    listed = spark.read.schema(lexical._ROWS).parquet(f"{path}/postings")
    assert listed.where("slice >= 0").count() <= 2 * 4 * spark.sparkContext.defaultParallelism  # a row for each chunk, field and slice


@pytest.mark.parametrize("k", [3, 40])
def test_stored_search_over_many_chunks_equals_scoring_everything(spark, tmp_path, monkeypatch, k):
    """Chunks and what a task holds may be small, documents lie in one partition, fields be searched in any number and order."""
    monkeypatch.setattr(lexical, "CHUNK", 4000)
    monkeypatch.setattr(lexical, "HELD_TEXT", 6000)
    rows, asked = lexical_case(2)
    docs, topics = spark.createDataFrame(rows, "docid string, body string, head string"), spark.createDataFrame(asked, "qid string, qtext string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would stay together
    try:
        lexical.build(docs.coalesce(1), path := str(tmp_path / "i"), ["body", "head"], per_range=7, slices=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    chunks = [r.chunk for r in spark.read.schema(lexical._ROWS).parquet(f"{path}/postings").where(F.col("slice") == lexical.DOCUMENTS).select("chunk").distinct().collect()]
    assert len(chunks) > 4 and len({c >> 33 for c in chunks}) > 1  # one partition was dealt out
    for fields in ({"head": 0.5, "body": 2.0}, {"body": 1.0}):
        search = lexical.Search(topics, path, fields, str(tmp_path / f"s{len(fields)}"), k=k, digits=6)
        assert sorted(map(tuple, search.run().collect())) == sorted(map(tuple, retrieve.bm25_top(topics, docs, fields, k, 6).collect()))


def test_stored_search_of_nothing(spark, tmp_path):
    docs, topics = spark.createDataFrame([("a", "x"), ("b", None)], "docid string, body string"), spark.createDataFrame([("q", "x y")], "qid string, qtext string")
    for name, d, t, want in (("all", docs, topics, [("q", "a", 1)]), ("no_docs", docs.limit(0), topics, []), ("no_topics", docs, topics.limit(0), []), ("no_words", docs.where("docid = 'b'"), topics, [])):
        lexical.build(d, path := str(tmp_path / name), ["body"], slices=4)
        found = lexical.Search(t, path, {"body": 1.0}, str(tmp_path / f"{name}-s"), k=5).run().collect()
        assert [(r.qid, r.docid, r["rank"]) for r in found] == want


def test_english_index_counts_lengths_without_stems_and_finds_the_same(spark, tmp_path):
    """Lengths are of words, so no row goes to Python to be counted; stems are made where postings are, of distinct words."""
    from rankloom.functions import stem as S

    texts = ["The cats' running motors, and a runner's", "motoring cats ran to Ponies", "it is the", "", None, "relational conditions relate; conditional CATS"]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts * 9)], "docid string, body string")
    topics = spark.createDataFrame([("1", "the relating cat"), ("2", "ponies or motors"), ("3", "the of")], "qid string, qtext string")
    assert "Eval" not in plan(lexical._cut(docs, ["body"], "english"))
    stemmed = docs.select("docid", F.array_join(S.english(F.col("body")), " ").alias("body"))
    asked = topics.select("qid", F.array_join(S.english(F.col("qtext")), " ").alias("qtext"))
    got = []
    for name, d, t, analyzer in (("e", docs, topics, "english"), ("p", stemmed, asked, "plain")):
        lexical.build(d, path := str(tmp_path / name), ["body"], analyzer, True, slices=4)
        got.append(sorted(map(tuple, lexical.Search(t, path, {"body": 1.0}, str(tmp_path / f"{name}-s"), analyzer, 7, 6).run().collect())))
    assert got[0] == got[1] and len(got[0]) == 14
