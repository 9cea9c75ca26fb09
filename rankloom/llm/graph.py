"""Connected components of a graph that no machine holds: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


#: Links of a node from which on it may be a hub, and hubs there may be for each shuffle partition.
HUB, HUBS = 1_000, 4


def _stars(pairs: DataFrame, emit, name: str) -> DataFrame:
    """Each node u of ``pairs`` (u, v) with m, the least of u and its neighbours, beside each neighbour.

    A node that holds more than its share of the pairs is no key of a shuffle: its least is broadcast. As such a node
    has over a part of all pairs, there are at most ``HUBS`` for each shuffle partition.
    """
    spark = pairs.sparkSession
    least = staged(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), name)
    total = least.agg(F.sum("n")).first()[0] or 0
    limit = max(HUB, total // (HUBS * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", "m"))
    of_hubs = pairs.join(hubs, "u")
    rest = pairs.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return emit(of_hubs.unionByName(rest))


def star_roots(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; root: the least node that can be reached.

    Rounds grow with the logarithm of the longest path. Neighbours are never a window or a list, and those of a hub
    never one task's. Collected: counts and a checksum a round.
    """
    state = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0)), F.coalesce(F.sum(F.xxhash64("b", "a") % 998_244_353), F.lit(0))).first())
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = state(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = staged(_stars(both, lambda j: j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), name).distinct(), name)
        small = _stars(
            large,
            lambda j: j.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b"),
            name,
        ).distinct()
        edges = staged(small, name)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
