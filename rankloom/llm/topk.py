"""Exact top-k inner products by distributed histogram selection.

Every query meets every candidate, in blocks: a block of query vectors times a block of table vectors is one
matrix product. No pass keeps scores. Each pass counts them in a histogram over the query's current range; the
counts, summed over all blocks, tell which bin holds the query's k-th score, and that bin becomes the range of the
next pass, until bins are single scores. The last pass emits what lies above the k-th score and, of what equals
it, the smallest ids, so ties need no more rows than k from any block.

A block leaves out the bins below its own k-th score: k scores at or above that one exist already, so the k-th
score of all is no lower. That is exact, and bounds a block's counts for a query by k bins.

Vectors are shuffled once, into blocks that lie as files in the shared folder. A task of a pass maps one table block
and reads the query blocks one after another, so what a pass shuffles is counts alone.

Edge cases. Null, or null or non-finite components: takes no part. An id on several rows: one vector, the least in
array order. Vectors of different lengths don't meet. Products too large for doubles are computed in longs or, beyond
those, in whole numbers of any size; a score among a query's k highest that no long can hold (beyond 2^63 - 1
either way) is an error, as the result could not be told. Fewer than k candidates: all of them. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import salt_of, staged, staged_path, vectors_of
from .store import put_rows, rows

#: Bytes and most rows of a table block; a query block has a quarter of the bytes and an eighth of the rows. Bins of a histogram.
BLOCK_BYTES, BLOCK, BINS = 16 << 20, 32_768, 256
#: The least rows of a table block that make it worth a task of its own, and scores that a task holds at once.
LEAST_BLOCK, AT_ONCE = 4096, 1 << 22
#: Scores beyond are counted as this one; the largest that a long can hold either way.
FAR, MOST = 2**62, 2**63 - 1


def dealt(df: DataFrame, count: int, folder: str, name: str) -> list[int]:
    """Write the rows of ``df`` (vec_id, …) to ``count`` files by the id's hash; returns the numbers that got none."""
    spark = df.sparkSession

    def write(table: pa.Table) -> pa.Table:
        number = table.column("_block")[0].as_py()
        put_rows(folder, f"{name}-{number}", table.drop_columns(["_block"]).combine_chunks())
        return pa.table({"id": pa.array([number], pa.int64())})

    there = staged(df.withColumn("_block", salt_of(F.col("vec_id"), count)).groupBy("_block").applyInArrow(write, "id long"), "blocks")
    return [r[0] for r in spark.range(count).join(there, "id", "left_anti").collect()]


def by_length(table: pa.Table) -> dict[int, dict]:
    """Of a block: its columns as arrays, apart by the vectors' length, in the order of ids."""
    table = table.combine_chunks().sort_by("vec_id")
    vec = table.column("vec").combine_chunks()
    lengths = np.asarray(vec.value_lengths())
    flat, ends = np.asarray(vec.flatten()), np.cumsum(lengths)
    out = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        matrix = flat.reshape(-1, n) if n and len(at) == len(lengths) else np.array([flat[ends[i] - n : ends[i]] for i in at]).reshape(len(at), n)
        out[int(n)] = {"mat": matrix} | {c: np.asarray(table.column(c).take(pa.array(at))) for c in table.column_names if c != "vec"}
    return out


def whole(mat: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as Python's whole numbers, exact for any finite x."""
    out = np.empty(mat.shape, object)
    for i, x in np.ndenumerate(mat):
        n, d = float(x).as_integer_ratio()
        out[i] = int(scale) * n // d if scale == int(scale) else int(np.floor(scale * x))
    return out


def products(a: np.ndarray, b: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray | None]:
    """Inner products of floor(scale * x) of the rows, exact, as longs held to ``MOST``; and where that changed them."""
    with np.errstate(over="ignore"):
        x, y = np.floor(a * scale), np.floor(b * scale)
    high_x, high_y = np.abs(x).max(axis=1, initial=0), np.abs(y).max(axis=1, initial=0)
    with np.errstate(over="ignore"):
        bound = max(1, a.shape[1]) * max(1.0, float(high_x.max(initial=0))) * max(1.0, float(high_y.max(initial=0)))
    if bound < 2**24:
        return (x.astype(np.float32) @ y.astype(np.float32).T).astype(np.int64), None
    if bound < 2**53:
        return (x @ y.T).astype(np.int64), None
    if bound < 2**63:
        return x.astype(np.int64) @ y.astype(np.int64).T, None
    usual = (2**52 / max(1, a.shape[1])) ** 0.5
    big_x, big_y = high_x > usual, high_y > usual
    out, over = np.zeros((len(a), len(b)), np.int64), np.zeros((len(a), len(b)), bool)
    if not big_x.all() and not big_y.all():
        out[np.ix_(~big_x, ~big_y)] = products(a[~big_x], b[~big_y], scale)[0]
    for rows_, cols in ((big_x, np.ones(len(b), bool)), (~big_x, big_y)):
        if rows_.any() and cols.any():
            exact = whole(a[rows_], scale) @ whole(b[cols], scale).T
            far = np.array(np.abs(exact) > MOST, bool)
            out[np.ix_(rows_, cols)] = np.where(far, np.where(exact > 0, MOST, -MOST), exact).astype(np.int64)
            over[np.ix_(rows_, cols)] = far
    return out, over


def meetings(folder: str, state: str, q_count: int, none: frozenset[int], scale: float):
    """table block numbers -> (queries with lo and width, table rows, scores, those held to ``MOST``), a few queries at a time.

    A query's own row has the least long as its score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict, np.ndarray, np.ndarray | None]]:
        for number in (n for batch in batches for n in batch.column(0).to_pylist()):
            table = by_length(rows(folder, f"v-{number}"))
            for block in range(q_count):
                if block in none:
                    continue
                ranges = rows(folder, f"{state}-{block}").sort_by("vec_id")
                ids, lo, width = (np.asarray(ranges.column(c)) for c in ("vec_id", "lo", "width"))
                queries = by_length(rows(folder, f"q-{block}"))
                for n in queries.keys() & table.keys():
                    q, v = queries[n], table[n]
                    place = np.minimum(np.searchsorted(ids, q["vec_id"]), len(ids) - 1)
                    open_ = np.flatnonzero(ids[place] == q["vec_id"])
                    step = max(1, AT_ONCE // len(v["vec_id"]))
                    for at in range(0, len(open_), step):
                        part = open_[at : at + step]
                        some = {"vec_id": q["vec_id"][part], "lo": lo[place[part]], "width": width[place[part]]}
                        s, over = products(q["mat"][part], v["mat"], scale)
                        own = np.minimum(np.searchsorted(v["vec_id"], some["vec_id"]), len(v["vec_id"]) - 1)
                        i = np.flatnonzero(v["vec_id"][own] == some["vec_id"])
                        s[i, own[i]] = np.iinfo(np.int64).min
                        yield some, v, s, over

    return run


def counted(meet, k: int, bins: int):
    """Of each pair of blocks: (vec_id, bin, n) for the bins from each query's local k-th score on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, _, s, _ in meet(batches):
            lo, width = q["lo"][:, None], q["width"][:, None]
            cell = np.clip((np.clip(s, -FAR, FAR) - lo) // width, -1, bins)  # bin 0 of the counts: below the range; the last: above
            cell[s == np.iinfo(np.int64).min] = -2
            cell += 2
            n = np.bincount((np.arange(len(s))[:, None] * (bins + 3) + cell).ravel(), minlength=len(s) * (bins + 3)).reshape(len(s), bins + 3)
            n[:, 0] = 0
            above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
            i, j = np.nonzero((n > 0) & (above < k))
            yield pa.record_batch([pa.array(q["vec_id"][i]), pa.array(j - 2), pa.array(n[i, j])], names=["vec_id", "bin", "n"])

    return run


def chosen(meet, k: int):
    """Of each pair of blocks: the scores above each query's k-th score, and the smallest ids at it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, v, s, over in meet(batches):
            i, j = np.nonzero(s >= np.maximum(q["lo"][:, None], -MOST))
            at = np.lexsort((v["vec_id"][j], -s[i, j], i))  # each query's rows, the best first
            i, j = i[at], j[at]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[best], j[best]
            fits = np.ones(len(i), bool) if over is None else ~over[i, j]
            yield pa.record_batch([pa.array(q["vec_id"][i]), pa.array(v["vec_id"][j]), pa.array(s[i, j]), pa.array(fits)], names=["query_id", "vec_id", "score", "fits"])

    return run


def sizes_of(vectors: DataFrame) -> tuple[int, int, float]:
    """Rows, the longest vector's length and the largest norm of ``vectors``."""
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(F.max(F.sqrt(square)), F.lit(0.0))).first()


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 1, bins: int = BINS, block: int | None = None, query_block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * x), ties to the smaller id.

    ``vectors`` and ``queries``: (vec_id, vec) from ``vectors_of``. Collected to the driver: counts, one norm, the
    number of queries whose range is still open, and the numbers of empty blocks. block, query_block: rows of a block.
    """
    spark = vectors.sparkSession
    vectors, queries = staged(vectors.select("vec_id", "vec"), "topk-vectors"), staged(queries.select("vec_id", "vec"), "topk-queries")
    n, size, norm = sizes_of(vectors)
    fit = max(1, BLOCK_BYTES // (8 * max(1, size)))
    block, query_block = block or min(BLOCK, fit), query_block or max(1, min(BLOCK // 8, fit // 4))
    v_count = max(1, -(-n // block), min(spark.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    q_count = max(1, -(-queries.count() // query_block))
    folder = staged_path(spark, "topk")
    empty, gone = dealt(vectors, v_count, folder, "v"), set(dealt(queries, q_count, folder, "q"))
    numbers = spark.range(0, v_count, 1, v_count).where(~F.col("id").isin(empty) if empty else F.lit(True))

    def meet(state: DataFrame, name: str):
        none = gone | set(dealt(state.select("vec_id", "lo", "width"), q_count, folder, name))
        return meetings(folder, name, q_count, frozenset(none), float(scale))

    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)) * scale
    slack = F.sqrt(F.greatest(F.size("vec"), F.lit(1)))  # floor lowers a component by less than one
    reach = F.least((length + slack) * (F.lit(float(norm) * scale) + F.lit(float(max(1, size)) ** 0.5)) * F.lit(1 + 1e-9), F.lit(2.0**61)).cast("long") + 1
    state = staged(queries.select("vec_id", (-reach).alias("lo"), F.ceil((2 * reach + 1) / F.lit(bins)).cast("long").alias("width"), F.lit(True).alias("open")), "topk-state")
    turn, least = 0, F.lit(-MOST)
    while state.where("open").limit(1).count():
        counts = numbers.mapInArrow(counted(meet(state.where("open"), f"range{turn}"), k, bins), "vec_id long, bin long, n long")
        counts = counts.groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
        w = W.partitionBy("vec_id").orderBy(F.desc("bin"))
        kth = counts.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") >= k).groupBy("vec_id").agg(F.max("bin").alias("bin"))
        # without a k-th score, or with one below a range that was held to longs, everything counts
        known = F.col("bin").isNotNull() & (F.col("bin") >= 0)
        lo = F.when(~F.col("open"), F.col("lo")).when(known, F.col("lo") + F.col("bin") * F.col("width")).otherwise(least)
        state = staged(
            state.join(kth, "vec_id", "left").select("vec_id", lo.alias("lo"), F.greatest(F.lit(1), F.ceil(F.col("width") / F.lit(bins)).cast("long")).alias("width"), (F.col("open") & known & (F.col("width") > 1)).alias("open")), "topk-state"
        )
        turn += 1
    found = numbers.mapInArrow(chosen(meet(state, "last"), k), "query_id long, vec_id long, score long, fits boolean")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    told = F.when(F.col("fits"), F.col("score")).otherwise(F.raise_error(F.concat(F.lit("no long can hold the score of query "), F.col("query_id"), F.lit(" and vector "), F.col("vec_id"))).cast("long"))
    return ranked.select("query_id", "rank", "vec_id", told.alias("score"))


def oracle(every: int, k: int, scale: int = 64) -> str:
    """Brute force in DuckDB over ``embeddings``."""
    return f"""
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor({scale} * x::DOUBLE))) AS vec FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
