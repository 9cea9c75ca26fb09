"""Corpus preparation: identifiers, duplicates, filters and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def as_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(docid, doctext); ids are strings throughout, so that ids of any kind meet."""
    return docs.select(F.col(key).cast("string").alias("docid"), F.col(text).alias("doctext"))


def last_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row for each key: the last by ``ordinal``. A map-side aggregate, no sort of the rows."""
    rest = [c for c in rows.columns if c not in (key, ordinal)]
    last = F.max_by(F.struct(*rest), F.col(ordinal)).alias("last")
    return rows.groupBy(key).agg(last, F.max(ordinal).alias(ordinal)).select(key, *[F.col(f"last.{c}").alias(c) for c in rest], ordinal)


def sampler_filter(corpus: DataFrame, name: str, text: str = "doctext") -> DataFrame:
    return corpus.where(T.long_enough(F.col(text), name))


def elbow_filter(corpus: DataFrame, text: str = "doctext") -> DataFrame:
    return corpus.where(T.long_enough_for_elbow(F.col(text)))


def with_text(vectors: DataFrame, corpus: DataFrame) -> DataFrame:
    """Vectors whose document is there and not empty."""
    return vectors.join(corpus.where(F.col("doctext") != "").select("docid"), "docid", "left_semi")


def looked_up(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows with their document's text; those without a document go."""
    return rows.join(corpus.where(F.col("doctext").isNotNull()), "docid")


def query_candidates(generated: DataFrame) -> DataFrame:
    """Cleaned queries that are neither empty nor outside ASCII: qid, qtext and the document they came from."""
    cleaned = generated.withColumn("qtext", T.mining_query(F.col("question")))
    return cleaned.where((F.col("qtext") != "") & T.is_ascii(F.col("qtext"))).select(F.col("docid").alias("qid"), "qtext", F.col("doctext").alias("positive"))


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The one length of all vectors; an error if there are several."""
    sizes = vectors.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} components")
    return sizes[0]


def composed(raw: DataFrame, style: str, column: str = "raw") -> Column:
    return T.titled(T.raw_field(F.col(column), "title"), T.raw_field(F.col(column), "text"), style)


def head_of_each(rows: DataFrame, files: str, order: str, count: int) -> DataFrame:
    """The first ``count`` rows of each input file."""
    from pyspark.sql import Window as W

    return rows.withColumn("_n", F.row_number().over(W.partitionBy(files).orderBy(order))).where(F.col("_n") <= count).drop("_n")


def wrapped(indices: DataFrame, rows: DataFrame, index: str, position: str) -> DataFrame:
    """``indices`` with the row at each index; rows are numbered from 0 by ``position``, and the index starts over at their end.

    No rows: no result. An index below 0 counts from the end, a null one has no row.
    """
    count = rows.count()
    if not count:
        return indices.join(rows, F.lit(False))
    return indices.join(rows, F.pmod(F.col(index), F.lit(count)) == F.col(position)).drop(position)
