"""Best-fit packing by patterns: few-document fillings of a sequence, how often each by non-negative least squares.

A document longer than a sequence is cut into full sequences and a rest; all other pieces stay whole. Pieces are
packed by their lengths alone: the histogram, at most ``capacity`` rows whatever the table holds, goes to the driver.
Lengths are put into ``CLASSES`` equal classes, rounded up; the patterns are all multisets of up to ``DEPTH`` classes
that fill a sequence exactly. Non-negative least squares finds how often each pattern is used so that the patterns
together ask for what the histogram holds. Long classes weigh more: short pieces find a place later anyway. The counts
are rounded down and cut to what is there. What is left, and what rounding up left free, is packed by best fit, longest first:
a piece goes where it leaves least room, and equal pieces go at once, so the work depends on the lengths and not on the table.
The plan then goes to the workers, where the n-th piece of a length looks up its place.

Edge cases. Null or empty text: the end id alone. Repeated rows, or repeated doc_ids: each row is a document of its
own. Null doc_id: a document like others. Empty table: empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, staged
from .packing import pieces, placed

CAPACITY, END_ID = 4096, 1
#: Classes of length, documents of a pattern, and what the weight of a class grows with its length by.
CLASSES, DEPTH, STEEP = 256, 3, 1.0
#: Pieces of one length that a task numbers at once, at most; fewer where they are more than 1 / (SHARES x shuffle partitions) of all.
NUMBERED, SHARES = 100_000, 8


def patterns(classes: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All falling tuples of at most ``depth`` classes that sum to ``classes``."""

    def parts(rest: int, most: int, left: int):
        if not rest:
            yield ()
        elif left:
            for c in range(min(rest, most), -(-rest // left) - 1, -1):
                for tail in parts(rest - c, c, left - 1):
                    yield (c, *tail)

    return list(parts(classes, classes, depth))


def non_negative(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """The x >= 0 with least |a x - b|, by active sets: columns enter by their gradient and leave where they would turn negative."""
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    small = 1e-9 * (1 + np.abs(b).max(initial=0))
    for _ in range(rounds or 3 * a.shape[1]):
        gradient = a.T @ (b - a @ x)
        gradient[inside] = -np.inf
        enter = int(np.argmax(gradient))
        if gradient[enter] <= small:
            break
        inside[enter] = True
        while True:
            own = np.flatnonzero(inside)
            best = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if (best > 0).all():
                x[own] = best
                break
            falling = best <= 0
            gap = x[own][falling] - best[falling]
            share = np.min(np.where(gap > 0, x[own][falling] / np.where(gap > 0, gap, 1), 0))
            x[own] += share * (best - x[own])
            out = own[falling & (x[own] <= small)]
            x[out], inside[out] = 0, False
            if not len(out):  # rounding: take the least out, so that the loop ends
                inside[own[np.argmin(best)]] = False
    return x


def repeats(counts: dict[int, int], capacity: int, classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, how often), at most what the classes hold."""
    width = -(-capacity // classes)
    classes = capacity // width
    have = np.zeros(classes + 1)
    for n, c in counts.items():
        if -(-n // width) <= classes:
            have[-(-n // width)] += c
    found = [p for p in patterns(classes, depth) if all(have[c] for c in p)]
    if not found:
        return []
    a = np.zeros((classes + 1, len(found)))
    for j, p in enumerate(found):
        np.add.at(a[:, j], list(p), 1)
    weight = (np.arange(classes + 1) / classes) ** STEEP
    scale = max(1.0, have.max())
    x = np.floor(non_negative(weight[:, None] * a, weight * have / scale) * scale + 1e-6).astype(np.int64)
    left, out = have.astype(np.int64), []
    for j in sorted(np.flatnonzero(x).tolist(), key=lambda j: (-x[j], j)):
        need = Counter(found[j])
        times = min(int(x[j]), *(int(left[c]) // k for c, k in need.items()))
        if times > 0:
            out.append((found[j], times))
            for c, k in need.items():
                left[c] -= k * times
    return out


def filled(counts: dict[int, int], capacity: int, used: list[tuple[tuple[int, ...], int]], classes: int = CLASSES) -> list[tuple[Counter, int]]:
    """(lengths of a sequence, how many such sequences): the patterns by exact lengths, then the rest by best fit."""
    width = -(-capacity // classes)
    left = Counter({n: c for n, c in counts.items() if c > 0})
    stock: dict[int, list[int]] = {}
    for n in sorted(left):
        stock.setdefault(-(-n // width), []).append(n)  # the longest of a class last
    rooms: list[tuple[int, int]] = []  # (room, number of the group), rising
    groups: list[tuple[Counter, int]] = []

    def add(lengths: Counter, times: int) -> None:
        groups.append((lengths, times))
        insort(rooms, (capacity - sum(n * c for n, c in lengths.items()), len(groups) - 1))

    def longest(lengths: list[int], chosen: Counter) -> int | None:
        while lengths and not left[lengths[-1]]:
            lengths.pop()
        return next((n for n in reversed(lengths) if left[n] > chosen[n]), None)

    for pattern, times in used:
        while times:
            lengths: Counter = Counter()
            for c in pattern[:-1]:
                if (n := longest(stock[c], lengths)) is not None:
                    lengths[n] += 1
            room = capacity - sum(n * k for n, k in lengths.items())
            last = next((n for n in range(room, max(0, room - len(pattern) * width), -1) if left[n] > lengths[n]), None)
            if sum(lengths.values()) < len(pattern) - 1 or last is None:
                break  # other patterns took these lengths; what they leave is packed below
            lengths[last] += 1
            now = min(times, *(left[n] // k for n, k in lengths.items()))
            for n, k in lengths.items():
                left[n] -= k * now
            add(lengths, now)
            times -= now

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            at = bisect_left(rooms, (n, -1))
            if at == len(rooms):
                each = capacity // n
                for k, times in ((each, count // each), (count % each, 1)):
                    if k and times:
                        add(Counter({n: k}), times)
                break
            room, number = rooms.pop(at)
            lengths, times = groups[number]
            each = min(room // n, count)
            now = min(times, count // each)
            if now < times:
                groups[number] = (lengths, times - now)
                insort(rooms, (room, number))
                groups.append((lengths + Counter({n: each}), now))
                insort(rooms, (room - each * n, len(groups) - 1))
            else:
                groups[number] = (lengths + Counter({n: each}), now)
                insort(rooms, (room - each * n, number))
            count -= each * now
    return groups


def plan_of(groups: list[tuple[Counter, int]], first: int) -> np.ndarray:
    """Rows (length, number of the first piece, pieces a sequence, first sequence, offset), by length and number."""
    taken: Counter = Counter()
    rows = []
    for lengths, times in groups:
        offset = 0
        for n, k in sorted(lengths.items(), reverse=True):
            rows.append((n, taken[n], k, first, offset))
            taken[n] += k * times
            offset += n * k
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _numbered(found: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``found`` with ``rank``, numbering the pieces of each length from 0. A common length is numbered in parts."""
    key, spread, parts, rows, before, number = free(found, "key", "spread", "parts", "rows", "before", "number")
    spark = found.sparkSession
    each = max(1, min(NUMBERED, sum(histogram.values()) // (SHARES * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    sizes = spark.createDataFrame([(n, -(-c // each)) for n, c in histogram.items()], f"length long, {parts} long")  # as few as the lengths
    dealt = found.join(F.broadcast(sizes), "length").withColumn(spread, F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.col(parts)))
    dealt = staged(dealt.drop(parts), "patterns-dealt")
    counts = dealt.groupBy("length", spread).agg(F.count("*").alias(rows))
    earlier = F.coalesce(F.sum(rows).over(W.partitionBy("length").orderBy(spread).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", spread, earlier.alias(before))
    within = F.row_number().over(W.partitionBy("length", spread).orderBy("doc_id", "start", "ids_crc32"))
    return dealt.withColumn(number, within).join(starts, ["length", spread]).withColumn("rank", F.col(before) + F.col(number) - 1).drop(spread, before, number)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Full pieces have a sequence each, numbered from 0; the planned ones follow. Collected and broadcast: the histogram of
    lengths and the plan, both bounded by the capacity.
    """
    spark = docs.sparkSession
    found = staged(pieces(docs, path, capacity, end_id), "patterns-pieces").drop("doc_tokens")
    every = {int(r[0]): int(r[1]) for r in found.groupBy("length").count().collect()}
    rest = {n: c for n, c in every.items() if n < capacity}
    groups = filled(rest, capacity, repeats(rest, capacity))
    plan = spark.sparkContext.broadcast(plan_of(groups, every.get(capacity, 0)))
    ranked = _numbered(found, every).select("doc_id", (F.col("start") / capacity).cast("int").alias("piece"), "start", "length", "ids_crc32", "rank")
    kind = dict(docs.dtypes)["doc_id"]
    return ranked.mapInArrow(placed(plan, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
