"""The three pipelines: which documents to annotate, what to train on, how well a ranking does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cluster, corpus, evaluate, mine, models, retrieve, sample


def sample_documents(docs: DataFrame, vectors: DataFrame, name: str = "", n_clusters: int = 1000, n_train: int = 1000, lam: float = 1.0, centroids: DataFrame | None = None) -> DataFrame:
    """(docid, doctext): a diverse sample of the corpus.

    Filter, cluster, allot quotas, draw five weighted samples from each cluster, and keep the quota that is most like
    the document nearest to the centroid (lam = 1) or least like one another.
    """
    kept = corpus.sampler_filter(docs, name)
    own = corpus.with_text(vectors, kept)
    centroids = cluster.fit_centroids(own, n_clusters) if centroids is None else centroids
    assignment = cluster.assigned(own, centroids)
    quota = cluster.quotas(cluster.sizes(assignment, "docid"), n_train)
    pool = sample.pool(cluster.affinities(assignment, own, centroids), quota)
    similar = sample.seed_similarity(pool, own, cluster.nearest_documents(own, centroids))
    chosen = sample.diversified(similar, lam)
    return corpus.looked_up(chosen.select("docid").distinct(), docs).select("docid", "doctext")


def generate_queries(docs: DataFrame, template: str, make: Callable = models.ExtractiveGenerator, most_words: int = 512) -> DataFrame:
    """(docid, doctext, question); doctext is cut to its first words, as it went into the prompt."""
    prompts = docs.select("docid", T.first_words(F.col("doctext"), most_words).alias("doctext"), T.prompt(template, F.col("doctext"), most_words).alias("prompt"))
    out = models.generated(prompts, make)
    return out.select("docid", "doctext", T.generated_query(F.col("output"), F.col("prompt")).alias("question"))


def mine_training(generated: DataFrame, docs: DataFrame, vectors: DataFrame, encoder: Callable = models.HashedEncoder, negatives: int = mine.NEGATIVES, k: int = retrieve.TOP_K) -> tuple[DataFrame, DataFrame]:
    """Training rows of a re-ranker, and triples of a late-interaction model."""
    queries = corpus.query_candidates(generated)
    encoded = models.encoded(queries.select("qid", "qtext"), encoder, "qtext", "qid")
    run = retrieve.dense(encoded, vectors, k)
    found = mine.hard_negatives(run, docs, negatives)
    return mine.reranker_rows(queries, found), mine.triples(queries, found)


def rerank(topics: DataFrame, docs: DataFrame, qrels: DataFrame, make: Callable = models.OverlapReranker, k: int = retrieve.TOP_K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First-stage run, re-ranked run, and the re-ranked run's metrics."""
    first = retrieve.bm25_top(topics, docs, {"doctext": 1.0}, k)
    scored = models.reranker_scores(retrieve.candidates(first, topics, docs, k), make)
    second = evaluate.reranked(scored)
    return first, second, evaluate.metrics(second, qrels)
