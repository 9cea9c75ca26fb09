"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source_size`` times in the mix. Along the source's
documents, the largest first, these expectations are prefix-summed, one random offset is added, and a document is
emitted once for each integer boundary that its stretch crosses. Neighbours in that order have nearly one
size, so what is taken stays within about one document's size of the target.

Edge cases. Null text: size 0. Null source: a source of its own, the last in order. A source whose documents
have no words: target 0, nothing is taken. Repeated rows: each is a document of its own, and takes its own place
in the order; ties in size by id, then by the whole row. Null doc_id: a document like others. Very long texts: one
size each. Empty table: empty result. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORDS, free, staged

#: A key's rows are numbered in this many parts, so that a hot (source, size) is no single task.
PARTS = 256
WEIGHTS = (3.0, 1.0, 2.0)


def size_of(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(totals: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """``totals`` (key, source_size) with target: its weight's part of ``share`` times all words, at most ``cap`` times
    its own size.

    Keys weigh by their order. The level of the weights is found in closed form: sources reach their cap in the order of
    cap / weight. Windows without a partition hold one small row a source, and no text.
    """
    place = (F.row_number().over(W.orderBy("key")) - 1) % len(weights)
    own = totals.withColumns({"w": F.element_at(F.array(*map(F.lit, map(float, weights))), place + 1), "most": F.lit(float(cap)) * F.col("source_size")})
    order = W.orderBy(F.col("most") / F.col("w"), "key")
    every = W.partitionBy(F.lit(1))
    filled = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - filled) / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    found = own.withColumns({"level": level, "n": F.row_number().over(order)})
    first = F.min_by(F.when(F.col("most") / F.col("w") > F.col("level"), F.col("level")), F.when(F.col("most") / F.col("w") > F.col("level"), F.col("n"))).over(every)
    return found.select("key", "source_size", F.least("most", F.col("w") * F.coalesce(first, F.lit(float("inf")))).alias("target"))


def offset_of(key: Column, seed: str) -> Column:
    """The source's random offset in [0, 1), the same in every run with this seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def with_copies(docs: DataFrame, size: Column, seed: str = "mix", share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` (doc_id, source and any more) with four columns more: size, source_size, target and copies.

    Their names, which no column of ``docs`` has, are returned beside. Ranks within a source come from two levels of
    counts: per (source, size), whose rows grow with the longest text and not with the table, and per part of a
    (source, size); no window holds a source's documents. Parts go by the id, and by the whole row where it is null.
    """
    c = dict(zip(("size", "source_size", "target", "copies", "key", "part", "tie", "rank", "n", "before", "within", "expected", "offset"), free(docs, *(f"_{x}" for x in ("size", "source_size", "target", "copies", "key", "part", "tie", "rank", "n", "before", "within", "expected", "offset"))), strict=True))
    own = F.xxhash64(*[F.col(f"`{x}`") for x, t in docs.dtypes if not t.startswith("map")])
    in_part = F.coalesce(F.col("doc_id").cast("string"), own.cast("string"))
    parted = docs.withColumns({c["size"]: size, c["key"]: F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")), c["part"]: F.substring(F.md5(in_part.cast("binary")), 1, 2), c["tie"]: own})
    counts = staged(parted.groupBy(c["key"], c["size"], c["part"]).agg(F.count("*").alias(c["n"])), "mix-counts")
    totals = counts.groupBy(F.col(c["key"]).alias("key")).agg(F.sum(F.col(c["size"]) * F.col(c["n"])).alias("source_size"))
    goal = targets(totals, share, cap, weights)
    plan = staged(
        goal.select(
            F.col("key").alias(c["key"]), F.col("source_size").alias(c["source_size"]), F.col("target").alias(c["target"]), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(c["expected"]), offset_of(F.col("key"), seed).alias(c["offset"])
        ),
        "mix-plan",
    )
    upto = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    by_size = counts.groupBy(c["key"], c["size"]).agg(F.sum(c["n"]).alias(c["n"]))
    by_size = by_size.select(c["key"], c["size"], F.coalesce(F.sum(c["n"]).over(upto(c["key"]).orderBy(F.desc(c["size"]))), F.lit(0)).alias(c["before"]))
    within = counts.select(c["key"], c["size"], c["part"], F.coalesce(F.sum(c["n"]).over(upto(c["key"], c["size"]).orderBy(c["part"])), F.lit(0)).alias(c["within"]))
    starts = within.join(by_size, [c["key"], c["size"]]).join(plan, c["key"])
    ranked = parted.withColumn(c["rank"], F.row_number().over(W.partitionBy(c["key"], c["size"], c["part"]).orderBy("doc_id", c["tie"])))
    rank = F.col(c["before"]) + F.col(c["within"]) + F.col(c["rank"])
    step = lambda r: F.floor(F.col(c["expected"]) * r + F.col(c["offset"]))
    out = ranked.join(starts, [c["key"], c["size"], c["part"]]).withColumn(c["copies"], (step(rank) - step(rank - 1)).cast("long"))
    return out.select(*[F.col(f"`{x}`") for x in docs.columns], *(c[x] for x in ("size", "source_size", "target", "copies"))), c


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words in the mix, repeats counted) and copies."""
    sized = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("words")), "mix-sizes")
    out, c = with_copies(sized, F.col("words"), **how)
    return out.select("doc_id", *(F.col(c[x]).alias(x) for x in ("size", "source_size", "target")), (F.col(c["copies"]) * F.col(c["size"])).alias("taken"), F.col(c["copies"]).alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as many times as it is taken."""
    out, c = with_copies(docs, size_of(F.col("text")), **how)
    (copy,) = free(out, "_copy")
    return out.where(F.col(c["copies"]) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(c["copies"]).cast("int")))).select(*[F.col(f"`{x}`") for x in docs.columns])


def oracle(seed: str = "mix") -> str:
    """The same mix as DuckDB SQL over ``documents``."""
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS w, 2e0 * source_size AS most FROM s),
p AS (SELECT *, 15e-1 * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS remain,
        sum(w) OVER (ORDER BY most / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight, row_number() OVER (ORDER BY most / w, source) AS n FROM o),
l AS (SELECT arg_min(remain / weight, n) FILTER (WHERE most / w > remain / weight) AS level FROM p),
t AS (SELECT source, source_size, least(most, w * coalesce(level, 1e300)) AS target, ('0x' || substr(md5('{seed}:' || coalesce('+' || source, '-')), 1, 8))::BIGINT / 4294967296e0 AS u FROM o, l),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size DESC, substr(md5(doc_id::VARCHAR), 1, 2), doc_id) AS k FROM d),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN (floor(target / source_size * k + u) - floor(target / source_size * (k - 1) + u))::BIGINT ELSE 0 END AS copies
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c"""
