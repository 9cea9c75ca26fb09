"""Ranks, losses and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .retrieve import top_of_each


def reranked(scored: DataFrame, k: int = 2**31 - 1) -> DataFrame:
    """``scored`` with its rank within the query, by score."""
    return top_of_each(scored, k)


def _gain(rel, rank):
    return F.greatest(rel, F.lit(0)) / F.log2(rank + 1.0)


class Listed:
    """Judgments that a table (qid, docid, rel) lists."""

    def __init__(self, qrels: DataFrame):
        self.qrels = qrels.select("qid", "docid", "rel")

    def of(self, run: DataFrame) -> DataFrame:
        """The rows of ``run`` (qid, docid, …) that are judged, with ``rel`` and how many ``times``."""
        return run.join(self.qrels, ["qid", "docid"]).withColumn("times", F.lit(1))

    def levels(self) -> DataFrame:
        """(qid, rel, n): how many documents of a query are judged so."""
        return self.qrels.groupBy("qid", "rel").agg(F.count("*").alias("n"))


class Classes:
    """Judgments by class: relevant to a query are the documents of its class but itself.

    What a table of them would list, row for row, without a row for each: ids are counted by class, and pairs are products of counts.
    """

    def __init__(self, queries: DataFrame, documents: DataFrame, key: str = "label"):
        self.queries = queries.where("qid IS NOT NULL").groupBy("qid", F.col(key).alias("_class")).agg(F.count("*").alias("_asked")).where("_class IS NOT NULL")
        self.documents = documents.where("docid IS NOT NULL").groupBy("docid", F.col(key).alias("_class")).agg(F.count("*").alias("_there")).where("_class IS NOT NULL")

    def of(self, run: DataFrame) -> DataFrame:
        rows = run.where("qid <> docid").join(self.queries, "qid").join(self.documents, ["docid", "_class"])
        return rows.select(*run.columns, F.lit(1).alias("rel"), (F.col("_asked") * F.col("_there")).alias("times"))

    def levels(self) -> DataFrame:
        size = self.documents.groupBy("_class").agg(F.sum("_there").alias("_size"))
        own = self.documents.select(F.col("docid").alias("qid"), "_class", F.col("_there").alias("_own"))
        n = F.col("_asked") * (F.col("_size") - F.coalesce("_own", F.lit(0)))
        return self.queries.join(size, "_class").join(own, ["qid", "_class"], "left").groupBy("qid").agg(F.sum(n).alias("n")).where("n > 0").select("qid", F.lit(1).alias("rel"), "n")


def _judgments(qrels):
    return Listed(qrels) if isinstance(qrels, DataFrame) else qrels


def ndcg(run: DataFrame, qrels: DataFrame | Listed | Classes, depth: int = 10) -> DataFrame:
    """(qid, ndcg) of every judged query: linear gain, the ideal over all judged documents, missing results 0.

    The ideal follows from how many documents have each level, so no query's judgments are sorted.
    """
    judged = _judgments(qrels)
    gained = judged.of(run.where(F.col("rank") <= depth).select("qid", "docid", "rank")).groupBy("qid").agg(F.sum(F.col("times") * _gain(F.col("rel"), F.col("rank"))).alias("dcg"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("qid").orderBy(F.desc("rel")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = judged.levels().withColumn("_before", before).where(F.col("_before") < depth)
    places = F.sequence(F.col("_before") + 1, F.least(F.col("_before") + F.col("n"), F.lit(depth)))
    ideal = placed.groupBy("qid").agg(F.sum(F.aggregate(places, F.lit(0.0), lambda s, p: s + _gain(F.col("rel"), p))).alias("best"))
    share = F.when(F.col("best") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("best")).otherwise(0.0)
    return ideal.join(gained, "qid", "left").select("qid", share.alias("ndcg"))


def recall(run: DataFrame, qrels: DataFrame | Listed | Classes, depth: int = 100) -> DataFrame:
    """(qid, recall) of every judged query: found of its relevant documents."""
    judged = _judgments(qrels)
    top = run.where(F.col("rank") <= depth).select("qid", "docid").dropDuplicates(["qid", "docid"])
    hits = judged.of(top).where(F.col("rel") >= 1).groupBy("qid").agg(F.sum("times").alias("hits"))
    there = judged.levels().groupBy("qid").agg(F.coalesce(F.sum(F.when(F.col("rel") >= 1, F.col("n"))), F.lit(0)).alias("all"))
    return there.join(hits, "qid", "left").select("qid", F.when(F.col("all") > 0, F.coalesce("hits", F.lit(0)) / F.col("all")).otherwise(0.0).alias("recall"))


def metrics(run: DataFrame, qrels: DataFrame | Listed | Classes, ndcg_depth: int = 10, recall_depth: int = 100) -> DataFrame:
    """(metric, value): means over all judged queries, by name."""
    means = ndcg(run, qrels, ndcg_depth).join(recall(run, qrels, recall_depth), "qid").agg(F.avg("ndcg").alias("n"), F.avg("recall").alias("r"))
    rows = F.explode(F.array(F.struct(F.lit(f"nDCG@{ndcg_depth}").alias("metric"), F.col("n").alias("value")), F.struct(F.lit(f"R@{recall_depth}").alias("metric"), F.col("r").alias("value"))))
    return means.select(rows.alias("m")).select("m.metric", "m.value")


def mean_squared_error(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("mse"))


def one_row_each(rows: DataFrame, key: str) -> DataFrame:
    """(rows, keys): equal, if no key occurs twice."""
    return rows.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"))
