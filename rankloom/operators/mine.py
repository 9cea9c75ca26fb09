"""Hard negatives from the tail of a ranking, and the training rows made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed value: negatives of each positive.
NEGATIVES = 4


def tail(run: DataFrame, negatives: int = NEGATIVES, compat: bool = False) -> DataFrame:
    """The last 2 * ``negatives`` ranks of each query, all of shorter lists.

    compat: lists of fewer ranks lose their head as a negative start of a slice would have it.
    """
    n = run.groupBy("qid").agg(F.count("*").alias("_n"))
    start = F.col("_n") - 2 * negatives
    if compat:
        start = F.when((start < 0) & (start + F.col("_n") > 0), start + F.col("_n")).otherwise(start)
    return run.join(n, "qid").where(F.col("rank") > F.greatest(start, F.lit(0))).drop("_n")


def hard_negatives(run: DataFrame, corpus: DataFrame, negatives: int = NEGATIVES, compat: bool = False, exclude_positive: bool = False) -> DataFrame:
    """(qid, docid, rank, negative): the first ``negatives`` documents of the tail that have a text.

    Only ids and ranks are windowed; texts are joined to what is left. A query's own document may be among them, unless
    ``exclude_positive`` says otherwise.
    """
    rows = tail(run.select("qid", "docid", "rank"), negatives, compat)
    if exclude_positive:
        rows = rows.where(F.col("docid") != F.col("qid"))
    there = rows.join(corpus.where(F.col("doctext").isNotNull()).select("docid"), "docid", "left_semi")
    w = W.partitionBy("qid").orderBy("rank")
    first = there.withColumn("place", F.row_number().over(w)).where(F.col("place") <= negatives)
    return first.join(corpus, "docid").select("qid", "docid", "rank", F.col("doctext").alias("negative"))


def reranker_rows(queries: DataFrame, negatives: DataFrame) -> DataFrame:
    """(qid, qtext, doctext, label): a query's positive, then its negatives; queries without negatives go."""
    kept = queries.join(negatives.select("qid").distinct(), "qid", "left_semi")
    positives = kept.select("qid", "qtext", F.col("positive").alias("doctext"), F.lit(1.0).alias("label"))
    others = queries.join(negatives, "qid").select("qid", "qtext", F.col("negative").alias("doctext"), F.lit(0.0).alias("label"))
    return positives.unionByName(others)


def triples(queries: DataFrame, negatives: DataFrame) -> DataFrame:
    """(qtext, pos, neg), on one line each: a row for each negative."""
    return queries.join(negatives, "qid").select(*[T.one_line(F.col(c)).alias(a) for c, a in (("qtext", "qtext"), ("positive", "pos"), ("negative", "neg"))])
