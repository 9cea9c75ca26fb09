"""The queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, htmltext, mixing, ngram, packing, patterns, pii, retention, simhash, topk, toxicity, warc, whitening
from .common import staged, vectors_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = staged(ann.usable(table(spark, sf_dir, "embeddings")), "ann-vectors")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.linked(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = staged(vectors_of(table(spark, sf_dir, "embeddings")), "topk-all")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20, scale=64)


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents")).select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op11_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.retention(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients"))


def op12_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pack(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_topk": topk.oracle(20, 20), "op9_mixing": mixing.oracle(), "op11_retention": retention.oracle()}
