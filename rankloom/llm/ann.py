"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by their id's hash, so shards are alike and any number of them can be built at once. A
shard's graph is kept as flat neighbour arrays, one per level. Nodes count as inserted in hash order: each links
to its diverse nearest among the nodes before it, which leaves the long links of early nodes, and those link
back. As a shard is of bounded size, the nearest of the nodes before are found by blocked matrix products
instead of a search of the unfinished graph. A search descends greedily to the lowest level and keeps a beam there;
all queries of a block take their steps together, as array operations. Shard results are merged by score.

Copies of a vector enter the index once, with the smallest of their ids; what a search finds is expanded to the
ids behind it, k + 1 of them at most, as a query takes k and may be one of them.

Edge cases. Null, zero, or null or non-finite components: takes no part. An id on several rows: one vector, the
least in array order. Vectors of other lengths than the query's don't meet it. Fewer than k candidates: all that are
found. Ties: the smaller id. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import salt_of, staged, staged_path, vectors_of
from .store import put_rows, rows
from .topk import by_length, dealt

#: Vectors of a shard, queries of a block.
SHARD, QUERY_BLOCK = 8192, 1024
#: Links a node makes (twice as many may arrive on the lowest level), candidates they are chosen from; the least width of the
#: beam, and its width for each component of the vectors, as more of them leave more ways to the nearest.
LINKS, CANDIDATES, BEAM, WIDER = 16, 48, 96, 2


def unit(mat: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows are scaled by their largest component first, so squares neither overflow nor vanish."""
    scaled = mat / np.abs(mat).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def levels(ids: np.ndarray, links: int = LINKS) -> tuple[np.ndarray, np.ndarray]:
    """Of each id: its place in the order of insertion, and its level; both from a hash, geometric as usual."""
    h = np.array([xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 7) for i in ids], np.uint64)
    return np.argsort(np.argsort(h, kind="stable"), kind="stable"), np.floor(-np.log(((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / np.log(links)).astype(int)


def diverse(x: np.ndarray, node: np.ndarray, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates, the nearest first (-1: none): up to ``most`` that are nearer to it than to one another."""
    out = np.full((len(node), most), -1, np.int32)
    for lo in range(0, len(node), 256):
        c, s = cand[lo : lo + 256], sim[lo : lo + 256]
        between = np.matmul(x[c], x[c].transpose(0, 2, 1))
        taken, count = np.zeros(c.shape, bool), np.zeros(len(c), int)
        for j in range(c.shape[1]):
            blocked = ((between[:, j] > s[:, j, None]) & taken).any(axis=1)
            taken[:, j] = (c[:, j] >= 0) & ~blocked & (count < most)
            count += taken[:, j]
        for j in range(c.shape[1]):  # places left go to the nearest of the rest
            spare = (c[:, j] >= 0) & ~taken[:, j] & (count < most)
            taken[:, j] |= spare
            count += spare
        i, j = np.nonzero(taken)
        out[lo + i, np.cumsum(taken, axis=1)[i, j] - 1] = c[i, j]
    return out


def layer(x: np.ndarray, order: np.ndarray, most: int, back: int, candidates: int) -> np.ndarray:
    """Neighbours (n, back) of the nodes of one level, -1 where there is none. order: when each was inserted."""
    n, k = len(x), min(candidates, len(x) - 1)
    if k < 1:
        return np.full((n, back), -1, np.int32)
    cand, sims = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, np.float32)
    for lo in range(0, n, 512):
        s = x[lo : lo + 512] @ x.T
        s[order[None, :] >= order[lo : lo + 512, None]] = -np.inf
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        val = np.take_along_axis(s, best, 1)
        at = np.lexsort((best, -val), axis=1)
        best, val = np.take_along_axis(best, at, 1), np.take_along_axis(val, at, 1)
        cand[lo : lo + 512], sims[lo : lo + 512] = np.where(np.isfinite(val), best, -1), val
    ahead = diverse(x, np.arange(n), cand, sims, most)
    a, j = np.nonzero(ahead >= 0)
    b = ahead[a, j].astype(np.int64)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    sim = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0, np.float32)
    at = np.lexsort((b, -sim, a))
    a, b, sim = a[at], b[at], sim[at]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    width = min(int(place.max(initial=0)) + 1, 2 * back)
    near = place < width
    cand, sims = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, np.float32)
    cand[a[near], place[near]], sims[a[near], place[near]] = b[near], sim[near]
    return diverse(x, np.arange(n), cand, sims, back)


def build(ids: np.ndarray, mat: np.ndarray, links: int = LINKS, candidates: int = CANDIDATES) -> dict:
    """The graph of one shard: for each level its nodes and flat neighbour array (places among the level's nodes)."""
    x = unit(mat).astype(np.float32)
    order, level = levels(ids, links)
    nodes, graph = [], []
    for at in range(level.max(initial=0) + 1):
        own = np.flatnonzero(level >= at)
        nodes.append(own.astype(np.int32))
        graph.append(layer(x[own], order[own], links, 2 * links if at == 0 else links, candidates))
        if len(own) == 1:
            break
    return {"x": x, "nodes": nodes, "graph": graph}


def search(shard: dict, q: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
    """Places (len(q), k) of the nearest nodes found for unit rows ``q``, the best first, -1 where there are fewer."""
    x, rows = shard["x"], np.arange(len(q))
    at = None
    for nodes, graph in zip(reversed(shard["nodes"][1:]), reversed(shard["graph"][1:]), strict=True):
        place = np.zeros(len(q), np.int64) if at is None else np.searchsorted(nodes, at)
        best = np.einsum("ij,ij->i", x[nodes[place]], q)
        while True:
            near = graph[place]
            sim = np.einsum("imd,id->im", x[nodes[near]], q)
            sim[near < 0] = -np.inf
            j = sim.argmax(axis=1)
            better = sim[rows, j] > best
            if not better.any():
                break
            place, best = np.where(better, near[rows, j], place), np.where(better, sim[rows, j], best)
        at = nodes[place].astype(np.int64)
    at = np.zeros(len(q), np.int64) if at is None else at
    n, graph = len(x), shard["graph"][0]
    beam = max(beam, k)
    ids, sims, done = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -np.inf, np.float32), np.zeros((len(q), beam), bool)
    seen = np.zeros((len(q), n), bool)
    ids[:, 0], sims[:, 0] = at, np.einsum("ij,ij->i", x[at], q)
    seen[rows, at] = True
    live = rows
    while len(live):
        open_ = np.where(done[live], -np.inf, sims[live])
        j = open_.argmax(axis=1)
        going = open_[np.arange(len(live)), j] > -np.inf
        live, j = live[going], j[going]
        if not len(live):
            break
        done[live, j] = True
        near = graph[ids[live, j]].astype(np.int64)
        new = (near >= 0) & ~seen[live[:, None], near]
        r, c = np.nonzero(new)
        seen[live[r], near[r, c]] = True
        sim = np.full(near.shape, -np.inf, np.float32)
        sim[r, c] = np.einsum("ij,ij->i", x[near[r, c]], q[live[r]])
        all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], sim], 1)
        all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live], sims[live], done[live] = (np.take_along_axis(m, keep, 1) for m in (all_ids, all_sims, all_done))
    ids = np.where(np.isfinite(sims), ids, -1)
    top = np.lexsort((ids, -sims), axis=1)[:, :k]
    return np.take_along_axis(ids, top, 1)


def packed(shard: dict) -> bytes:
    """The graph as bytes: level sizes and widths, then nodes and neighbours of each level."""
    head = [len(shard["nodes"]), *(n for nodes, g in zip(shard["nodes"], shard["graph"], strict=True) for n in g.shape)]
    return b"".join([np.array(head, "<i4").tobytes(), *(m.astype("<i4").tobytes() for pair in zip(shard["nodes"], shard["graph"], strict=True) for m in pair)])


def unpacked(data, mat: np.ndarray) -> dict:
    flat = np.frombuffer(data, "<i4")
    n, at = int(flat[0]), 1 + 2 * int(flat[0])
    nodes, graph = [], []
    for i in range(n):
        rows, width = int(flat[1 + 2 * i]), int(flat[2 + 2 * i])
        nodes.append(flat[at : at + rows])
        graph.append(flat[at + rows : at + rows + rows * width].reshape(rows, width))
        at += rows * (1 + width)
    return {"x": unit(mat).astype(np.float32), "nodes": nodes, "graph": graph}


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, vec, ids): each vector once, with the k + 1 smallest of its ids, in order; vec_id is the first."""
    w = W.partitionBy("vec").orderBy("vec_id")
    few = vectors.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "vec", "ids")


def index(vectors: DataFrame, k: int, folder: str, shard: int = SHARD, links: int = LINKS, candidates: int = CANDIDATES) -> tuple[int, list[int]]:
    """Build the shards of ``vectors`` as files of ``folder``; returns their number, and the numbers that got no vector.

    A file has a row for each length n of its vectors: n, ids, ends, mat, graph.
    """
    spark = vectors.sparkSession
    each = staged(distinct_vectors(vectors, k), "ann-distinct")
    count = max(1, -(-each.count() // shard))

    def write(table: pa.Table) -> pa.Table:
        number = table.column("_shard")[0].as_py()
        table = table.combine_chunks().sort_by("vec_id")
        length = np.asarray(table.column("vec").combine_chunks().value_lengths())
        out = []
        for n in np.unique(length):
            part = table.take(pa.array(np.flatnonzero(length == n)))
            ids, mat = part.column("ids").combine_chunks(), np.asarray(part.column("vec").combine_chunks().flatten()).reshape(-1, n)
            graph = packed(build(np.asarray(part.column("vec_id")), mat, links, candidates))
            out.append((int(n), np.asarray(ids.flatten()).astype("<i8").tobytes(), np.cumsum(np.asarray(ids.value_lengths())).astype("<i8").tobytes(), mat.astype("<f8").tobytes(), graph))
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.large_binary()] * 4), strict=True)]
        put_rows(folder, f"shard-{number}", pa.table(cols, names=["n", "ids", "ends", "mat", "graph"]))
        return pa.table({"id": pa.array([number], pa.int64())})

    there = staged(each.withColumn("_shard", salt_of(F.col("vec_id"), count)).groupBy("_shard").applyInArrow(write, "id long"), "ann-shards")
    return count, [r[0] for r in spark.range(count).join(there, "id", "left_anti").collect()]


def found(folder: str, q_count: int, none: frozenset[int], k: int, beam: int):
    """shard numbers -> (query_id, vec_id, score), the k best ids of each query in the shard, query block by query block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (x for batch in batches for x in batch.column(0).to_pylist()):
            shard = rows(folder, f"shard-{number}")
            parts = {}
            for i, n in enumerate(shard.column("n").to_pylist()):
                ids, ends, mat = (np.frombuffer(shard.column(c)[i].as_buffer(), t) for c, t in (("ids", "<i8"), ("ends", "<i8"), ("mat", "<f8")))
                mat = mat.reshape(-1, n)
                parts[n] = ids, ends, np.concatenate([[0], ends[:-1]]), mat, unpacked(shard.column("graph")[i].as_buffer(), mat)
            for block in (b for b in range(q_count) if b not in none):
                queries = by_length(rows(folder, f"q-{block}"))
                for n in queries.keys() & parts.keys():
                    yield _best(queries[n], *parts[n], k, beam)

    return run


def _best(q: dict, ids: np.ndarray, ends: np.ndarray, starts: np.ndarray, mat: np.ndarray, graph: dict, k: int, beam: int) -> pa.RecordBatch:
    got = search(graph, unit(q["mat"]).astype(np.float32), k + 1, max(beam, WIDER * mat.shape[1]))
    row, col = np.nonzero(got >= 0)
    at = got[row, col]
    score = cosine(q["mat"][row], mat[at])
    times = ends[at] - starts[at]
    row, score = np.repeat(row, times), np.repeat(score, times)
    vec = ids[np.repeat(starts[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    other = vec != q["vec_id"][row]
    row, score, vec = row[other], score[other], vec[other]
    order = np.lexsort((vec, -score, row))
    row, score, vec = row[order], score[order], vec[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.record_batch([pa.array(q["vec_id"][row[best]]), pa.array(vec[best]), pa.array(score[best])], names=["query_id", "vec_id", "score"])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; rows are scaled first only where squares would leave its range."""
    big = np.maximum(np.abs(a).max(axis=1), np.abs(b).max(axis=1))
    small = np.minimum(np.abs(a).max(axis=1), np.abs(b).max(axis=1))
    far = (big > 1e140) | (small < 1e-140)
    if far.any():
        a, b = a.copy(), b.copy()
        a[far] /= np.abs(a[far]).max(axis=1, keepdims=True)
        b[far] /= np.abs(b[far]).max(axis=1, keepdims=True)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, shard: int = SHARD, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that the index finds.

    Shards and query blocks lie as files in the shared folder: a task maps one shard, reads the query blocks one
    after another, and sends k rows a query. Collected: two row counts, and the numbers of empty shards and blocks.
    """
    spark = vectors.sparkSession
    folder = staged_path(spark, "ann")
    count, empty = index(vectors, k, folder, shard)
    n_blocks = max(1, -(-queries.count() // query_block))
    none = frozenset(dealt(queries.select("vec_id", "vec"), n_blocks, folder, "q"))
    numbers = spark.range(0, count, 1, count).where(~F.col("id").isin(empty) if empty else F.lit(True))
    out = numbers.mapInArrow(found(folder, n_blocks, none, k, beam), "query_id long, vec_id long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(df: DataFrame) -> DataFrame:
    """``vectors_of`` without zero vectors."""
    return vectors_of(df).where(F.exists("vec", lambda x: x != 0))
