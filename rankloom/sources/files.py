"""The files that ranker training exchanges, each read with a schema and written by Spark's writers."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CORPUS = "docid string, doctext string"
GENERATED = "docid string, doctext string, question string"
RUN = "qid string, q0 string, docid string, rank int, score double, tag string"
QRELS = "qid string, iter string, docid string, rel int"
TOPICS = "qid string, qtext string"
TRIPLES = "qtext string, pos string, neg string"
RANKING = "qid string, docid string, rank int, score double"
TEST_DATA = "qid string, qtext struct<title:string>, passages array<array<string>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; ids may be numbers or strings, a row of another shape is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("primitivesAsString", True).json(path)


def write_json(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, CORPUS)


def read_generated(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, GENERATED)


def _separated(spark: SparkSession, path: str, schema: str, sep: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("quote", "").option("mode", "FAILFAST").csv(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return _separated(spark, path, RUN, " ")


def write_run(run: DataFrame, path: str, tag: str = "rankloom") -> None:
    run.select(F.concat_ws(" ", "qid", F.lit("Q0"), "docid", "rank", "score", F.lit(tag))).write.text(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return _separated(spark, path, QRELS, " ").select("qid", "docid", "rel")


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels.select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("0"), F.col("docid").cast("string"), F.col("rel").cast("int"))).write.text(path)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return _separated(spark, path, TOPICS, "\t")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return _separated(spark, path, TRIPLES, "\t")


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    return _separated(spark, path, RANKING, "\t")


def write_tabbed(rows: DataFrame, path: str) -> None:
    """Tab-separated lines without escapes; tabs and line ends in a text become blanks."""
    rows.select(F.concat_ws("\t", *[T.one_line(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns])).write.text(path)


def write_topics(topics: DataFrame, path: str) -> None:
    write_tabbed(topics.select("qid", "qtext"), path)


def write_ranking(run: DataFrame, path: str) -> None:
    write_tabbed(run.select("qid", "docid", "rank", "score"), path)


def write_curve(curve: DataFrame, path: str) -> None:
    """(k, sse) so far, in place of what was written after the k before."""
    write_json(curve, path, "overwrite")


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("k int, sse double").option("mode", "FAILFAST").json(path)


def write_training(rows: DataFrame, path: str) -> None:
    """One JSON array a line: query, document, label."""
    row = F.to_json(F.array(*[F.col(c).cast("variant") for c in ("qtext", "doctext", "label")]))
    rows.select(row).write.text(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    row = F.from_json("value", "array<string>")
    return spark.read.text(path).select(row.alias("r")).select(F.col("r")[0].alias("qtext"), F.col("r")[1].alias("doctext"), F.col("r")[2].cast("double").alias("label"))


def nested(candidates: DataFrame) -> DataFrame:
    """(qid, qtext, passages) of candidates (qid, qtext, docid, rank, text), passages by rank."""
    best = F.array_sort(F.collect_list(F.struct("rank", "docid", "text")))
    rows = candidates.groupBy("qid").agg(F.first("qtext").alias("qtext"), best.alias("p"))
    return rows.select("qid", F.struct(F.col("qtext").alias("title")).alias("qtext"), F.transform("p", lambda x: F.array(x.docid, x.text)).alias("passages"))


def flat(test_data: DataFrame) -> DataFrame:
    """(qid, qtext, docid, rank, text) of nested test data."""
    rows = test_data.select("qid", F.col("qtext.title").alias("qtext"), F.posexplode("passages").alias("pos", "p"))
    return rows.select("qid", "qtext", F.col("p")[0].alias("docid"), (F.col("pos") + 1).alias("rank"), F.col("p")[1].alias("text"))


def read_test_data(spark: SparkSession, path: str, one_array: bool = True) -> DataFrame:
    """Nested test data: a file that is one JSON array, or JSON lines."""
    return spark.read.schema(TEST_DATA).option("multiLine", one_array).json(path)


def predictions(scored: DataFrame) -> DataFrame:
    """(qid, scores): a map from document to score for each query; of a repeated document the highest counts."""
    once = scored.groupBy("qid", "docid").agg(F.max("score").alias("score"))
    return once.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("docid", "score"))).alias("scores"))


def write_raw_predictions(scored: DataFrame, path: str) -> None:
    """A model's outputs with their labels, a row a pair: (qid, docid, score, label), as Parquet."""
    scored.select("qid", "docid", "score", "label").write.parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(docid, embedding); ids are strings."""
    return spark.read.parquet(path).select(F.col("docid").cast("string").alias("docid"), F.col("embedding").cast("array<float>").alias("embedding"))


def read_template(path: str, shots: str = "3-shot", spark: SparkSession | None = None) -> str:
    """A prompt template from a YAML file: {shots: {template: ...}}. With a session the file may lie wherever Spark reads."""
    if spark:
        text = spark.read.text(path, wholetext=True).first()[0]
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    try:
        import yaml

        return yaml.safe_load(text)[shots]["template"]
    except ImportError:  # a block scalar is all that is needed
        lines = text.split("\n")
        at = next(i for i, x in enumerate(lines) if re.fullmatch(rf"[\"']?{re.escape(shots)}[\"']?:\s*", x))
        body = lines[at + 2 :]
        body = body[: next((i for i, x in enumerate(body) if x and not x.startswith(" ")), len(body))]
        indent = min(len(x) - len(x.lstrip()) for x in body if x.strip())
        return "\n".join(x[indent:] for x in body).rstrip("\n") + "\n"


def first_checkpoint(folder: str) -> str | None:
    """Of the folders named like checkpoint-100 the one with the smallest number."""
    found = [(int(m[1]), x) for x in os.listdir(folder) if "checkpoint" in x and (m := re.search(r"(\d+)$", x))]
    return os.path.join(folder, min(found)[1]) if found else None
