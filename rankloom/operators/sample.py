"""Drawing documents from clusters: weighted draws without replacement, then relevance against redundancy."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vector as V

# The seeds of the five draws, and the temperature of the weights.
DRAW_SEEDS = (35, 745, 10, 6534, 2)
TEMPERATURE = 1.0


def uniform(key, seed: int):
    """A number strictly between 0 and 1 that depends on key and seed alone."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"|{seed}")).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**32)


def pool(affinity: DataFrame, quota: DataFrame, seeds: tuple[int, ...] = DRAW_SEEDS, temperature: float = TEMPERATURE) -> DataFrame:
    """(cluster, docid, quota): all documents that one of the draws picks.

    A draw of ``quota`` documents without replacement, each with weight exp(cos / temperature), is the top ``quota`` of
    cos / temperature plus Gumbel noise. A task reads its rows once and keeps a sketch: of each cluster and draw the
    best ``quota`` so far, which merge by keeping the best again. What is shuffled are these, not the documents.
    """
    own = affinity.join(quota.select("cluster", "quota"), "cluster")
    keys = F.array(*[F.col("cos") / F.lit(temperature) - F.log(-F.log(uniform(F.col("docid"), s))) for s in seeds])
    drawn = sketches(own.select("cluster", "docid", "quota", keys.alias("keys")), len(seeds))
    w = W.partitionBy("cluster", "draw").orderBy(F.desc("key"), "docid")
    return drawn.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("quota")).select("cluster", "docid", "quota").distinct()


#: Rows that a task takes in before it cuts its sketch down again.
SKETCH_ROWS = 65_536


def sketches(rows: DataFrame, draws: int) -> DataFrame:
    """(cluster, draw, docid, quota, key): of rows (cluster, docid, quota, keys) each task's best ``quota`` by cluster and draw, ties to the smaller docid."""
    kind = dict(rows.dtypes)["cluster"]

    def best(kept: pa.Table) -> pa.Table:
        kept = kept.sort_by([("cluster", "ascending"), ("draw", "ascending"), ("key", "descending"), ("docid", "ascending")])
        cluster, draw = np.asarray(kept.column("cluster").dictionary_encode().combine_chunks().indices), np.asarray(kept.column("draw"))
        new = np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (draw[1:] != draw[:-1])])
        first = np.flatnonzero(new)
        place = np.arange(len(draw)) - np.repeat(first, np.diff([*first, len(draw)]))
        return kept.filter(pa.array(place < np.asarray(kept.column("quota"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = pa.array(np.repeat(np.arange(n), draws))
            table = pa.Table.from_batches([batch]).take(at)
            kept.append(pa.table({"cluster": table["cluster"], "draw": pa.array(np.tile(np.arange(draws, dtype=np.int32), n)), "docid": table["docid"], "quota": table["quota"], "key": batch.column("keys").flatten()}))
            if sum(t.num_rows for t in kept) > SKETCH_ROWS + 2 * kept[0].num_rows:
                kept = [best(pa.concat_tables(kept))]
        if kept:
            yield from best(pa.concat_tables(kept)).to_batches()

    return rows.mapInArrow(run, f"cluster {kind}, draw int, docid string, quota long, key double")


def seed_similarity(pooled: DataFrame, vectors: DataFrame, seeds: DataFrame, column: str = "embedding") -> DataFrame:
    """(cluster, docid, quota, sim): cosine to the cluster's seed document, which may lie outside of the pool."""
    v = vectors.select("docid", F.col(column).alias("vec"))
    of_seed = seeds.select("cluster", "docid").join(v, "docid").select("cluster", F.col("vec").alias("seed_vec"))
    return pooled.join(v, "docid").join(of_seed, "cluster").select("cluster", "docid", "quota", "vec", V.cosine(F.col("vec"), F.col("seed_vec")).alias("sim"))


def pair_similarity(pooled: DataFrame, vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(cluster, a, b, cos) of all ordered pairs in a cluster's pool; pools are a few quotas large."""
    v = pooled.select("cluster", "docid").join(vectors.select("docid", F.col(column).alias("vec")), "docid")
    a = v.select("cluster", F.col("docid").alias("a"), F.col("vec").alias("va"))
    b = v.select("cluster", F.col("docid").alias("b"), F.col("vec").alias("vb"))
    return a.join(b, "cluster").select("cluster", "a", "b", V.cosine(F.col("va"), F.col("vb")).alias("cos"))


def mmr_order(vecs: np.ndarray, sim: np.ndarray, names: list[str], count: int, lam: float) -> list[tuple[int, float]]:
    """(place, score) of the best ``count`` by greedy maximal marginal relevance.

    From the second pick on, scores only fall, as a candidate gets ever nearer to what is picked. So a queue holds each
    by its last known score, and only one at the head is compared with the picks that it missed: if it stays at the head, no
    other can be better. For the same reason one pick more than wanted, sorted by score, is exact. Ties: the smaller id.
    """
    if not len(names) or count < 1:
        return []
    unit = vecs / np.sqrt((vecs * vecs).sum(1, keepdims=True))
    first = min(range(len(names)), key=lambda i: (-round(lam * float(sim[i]), 12), names[i]))
    picks, out = [first], [(first, lam * float(sim[first]))]
    closest = unit @ unit[first]
    known = lam * sim - (1 - lam) * closest
    queue = [(-round(float(known[i]), 12), names[i], i, 1) for i in range(len(names)) if i != first]
    heapq.heapify(queue)
    while queue and len(picks) <= count:
        _, name, i, seen = heapq.heappop(queue)
        if seen < len(picks):
            closest[i] = max(closest[i], float((unit[picks[seen:]] @ unit[i]).max()))
            known[i] = lam * sim[i] - (1 - lam) * closest[i]
            entry = (-round(float(known[i]), 12), name, i, len(picks))
            if queue and queue[0] < entry:
                heapq.heappush(queue, entry)
                continue
        picks.append(i)
        out.append((i, float(known[i])))
    return sorted(out, key=lambda x: (-round(x[1], 12), names[x[0]]))[:count]


def diversified(similar: DataFrame, lam: float = 1.0, most: int | None = None) -> DataFrame:
    """(cluster, docid, score): each cluster's quota. lam = 1 is plain top-k and needs no Python.

    most: a bound of all quotas. With it the window has a limit that each map task applies before the shuffle.
    """
    if lam == 1.0:
        w = W.partitionBy("cluster").orderBy(F.desc("sim"), "docid")
        placed = similar.withColumn("place", F.row_number().over(w))
        placed = placed if most is None else placed.where(F.col("place") <= most)
        return placed.where(F.col("place") <= F.col("quota")).select("cluster", "docid", F.col("sim").alias("score"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf["docid"].tolist()
        best = mmr_order(np.array(pdf["vec"].tolist(), float), pdf["sim"].to_numpy(), names, int(pdf["quota"].iloc[0]), lam)
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[0], "docid": [names[i] for i, _ in best], "score": [s for _, s in best]})

    return similar.select("cluster", "docid", "quota", V.doubles(F.col("vec")).alias("vec"), "sim").groupBy("cluster").applyInPandas(pick, "cluster long, docid string, score double")
