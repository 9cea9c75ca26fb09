import numpy as np
from pyspark.sql import functions as F

from rankloom.operators import models, retrieve
from rankloom.plans import pipelines
from rankloom.plans.queries import TEMPLATE
from rankloom.sources import files


def corpus(spark, n=80):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]
    return spark.createDataFrame([(str(i), " ".join(rng.choice(words, 60))) for i in range(n)] + [("short", "no"), ("empty", "")], "docid string, doctext string")


def test_sample_documents(spark):
    docs = corpus(spark).cache()
    vectors = models.encoded(docs).cache()
    for lam in (1.0, 0.5):
        got = pipelines.sample_documents(docs, vectors, "other", n_clusters=4, n_train=12, lam=lam)
        ids = [r.docid for r in got.collect()]
        assert len(ids) == len(set(ids)) == 12 and not {"short", "empty"} & set(ids)


def test_from_documents_to_training_files(spark, tmp_path):
    docs = corpus(spark).cache()
    generated = pipelines.generate_queries(docs.where("docid <> 'empty'").limit(6), TEMPLATE)
    files.write_json(generated, str(tmp_path / "generated"))
    again = files.read_generated(spark, str(tmp_path / "generated"))
    rows, triples = pipelines.mine_training(again, docs, models.encoded(docs), k=20)
    by = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert by[1.0] == 6 and by[0.0] == 24 and triples.count() == 24
    files.write_tabbed(triples, str(tmp_path / "triples"))
    assert files.read_triples(spark, str(tmp_path / "triples")).count() == 24


def test_rerank(spark):
    docs = corpus(spark).cache()
    topics = docs.where("docid in ('3', '9')").select(F.col("docid").alias("qid"), F.col("doctext").alias("qtext"))
    qrels = topics.select("qid", F.col("qid").alias("docid"), F.lit(1).alias("rel"))
    first, second, means = pipelines.rerank(topics, docs, qrels, k=30)
    assert {r.docid for r in first.where("rank = 1").collect()} == {r.docid for r in second.where("rank = 1").collect()} == {"3", "9"}
    assert {r.metric: r.value for r in means.collect()} == {"nDCG@10": 1.0, "R@100": 1.0}


def test_late_interaction_with_all_partitions_is_exact(spark):
    rng = np.random.default_rng(2)
    tokens = spark.createDataFrame([(f"d{i}", p, rng.normal(size=4).tolist()) for i in range(30) for p in range(3)], "docid string, pos int, dvec array<double>").cache()
    q = tokens.where("docid in ('d1', 'd2')").select(F.col("docid").alias("qid"), F.col("pos").alias("qpos"), F.col("dvec").alias("qvec"))
    centroids = retrieve.partition_centroids(tokens, 5, share=1.0)
    got = {(r.qid, r.docid): r.score for r in retrieve.late_interaction(q, tokens, centroids, 30, 5).collect()}
    full = {(r.qid, r.docid): r.score for r in retrieve.max_sim(q, tokens.select(F.explode(F.array(F.lit("d1"), F.lit("d2"))).alias("qid"), "docid", "dvec")).collect()}
    assert len(got) == 60 and all(abs(got[x] - full[x]) < 1e-9 for x in full)
