"""Lloyd's k-means for several problems at once: one scan of the vectors an iteration, whatever their number.

A problem is a range of components and its starting centroids. All problems that still move share a scan, so the scans of a
sweep over many k are those of its slowest k. A task sends, for each cluster it met, a sum and a count. Centroids are
held in groups about some of their own; a group is skipped for a vector if its nearest member can't be nearer than
what was found: distance to the group's middle less the group's radius, by the triangle inequality. Where that skips little,
all distances are taken, in single precision; vectors whose two nearest centroids are closer than its error are decided in double.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V

#: Centroids up to which groups don't pay, vectors that a task compares at once, and bytes of centroids that one scan serves.
PLAIN, AT_ONCE, LARGEST = 64, 2048, 256 << 20
#: Vectors that groups are tried on first, the share of distances from which they don't pay, and distances that a task has at once without them.
TRIED, PAYS, CELLS = 256, 0.25, 1 << 21


@dataclass
class Problem:
    start: np.ndarray
    lo: int = 0
    hi: int | None = None


@dataclass
class Fit:
    """centroids, sums of squared distances, and of (1 - cosine) squared, to them; scans and distances that it took."""

    centroids: np.ndarray
    sse: float = 0.0
    cosine_sse: float = 0.0
    scans: int = 0
    distances: int = 0


class Grouped:
    """Centroids in about sqrt(k) groups, each about one of them, with the group's radius, as long as groups pay."""

    def __init__(self, c: np.ndarray):
        self.c, self.squares, self.counted, self.single = c, (c * c).sum(1), 0, None
        self.groups: list[np.ndarray] = []
        if len(c) > PLAIN:
            middles = c[:: max(1, round(len(c) ** 0.5))]
            home = _squared(c, self.squares, middles, (middles * middles).sum(1)).argmin(1)
            self.groups = [np.flatnonzero(home == g) for g in range(len(middles))]
            self.middles, self.middle_squares = middles, (middles * middles).sum(1)
            self.radius = np.array([np.sqrt(((c[m] - middles[g]) ** 2).sum(1).max(initial=0)) for g, m in enumerate(self.groups)])

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row, ties to the smaller number."""
        out, lo, step = np.empty(len(x), np.int64), 0, TRIED
        while lo < len(x):
            if not self.groups:
                step = max(1, min(AT_ONCE, CELLS // len(self.c)))
            part, before = x[lo : lo + step], self.counted
            out[lo : lo + step] = self._of_groups(part) if self.groups else self._of_all(part)
            if self.groups and self.counted - before > PAYS * len(part) * len(self.c):
                self.groups = []
            lo, step = lo + step, AT_ONCE
        return out

    def _of_all(self, x: np.ndarray) -> np.ndarray:
        if self.single is None:
            with np.errstate(over="ignore"):
                self.single = np.ascontiguousarray(np.concatenate([-2 * self.c, self.squares[:, None]], 1).T.astype(np.float32))
            self.longest, self.room = np.sqrt(self.squares.max()), np.empty((max(1, min(AT_ONCE, CELLS // len(self.c))), len(self.c)), np.float32)
        self.counted += len(x) * len(self.c)
        squares, rows = (x * x).sum(1), np.arange(len(x))
        with np.errstate(over="ignore", invalid="ignore"):
            d = np.matmul(np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float32), self.single, out=self.room[: len(x)])  # without the vector's own square
            at = d.argmin(1)
            least = d[rows, at].astype(float)
            d[rows, at] = np.inf
            bound = self.longest * (2 * np.sqrt(squares) + self.longest)
            # twice the rounding of a sum of so many products; out of single precision's range nothing is decided
            error = np.where((bound < 1e30) & (self.longest > 1e-15), 1.1 * 2.0**-23 * (x.shape[1] + 4) * bound, np.inf)
            near = np.flatnonzero(~(d.min(1) - least > error))
        if len(near):
            self.counted += len(near) * len(self.c)
            at[near] = _squared(x[near], squares[near], self.c, self.squares).argmin(1)
        return at

    def _of_groups(self, x: np.ndarray) -> np.ndarray:
        squares = (x * x).sum(1)
        self.counted += len(x) * len(self.middles)
        near = np.sqrt(_squared(x, squares, self.middles, self.middle_squares))
        least = near - self.radius  # no member of the group is nearer
        best, at = np.full(len(x), np.inf), np.full(len(x), len(self.c), np.int64)
        first = near.argmin(1)
        for own in (True, False):  # the group of the nearest middle first, so that others are skipped
            for g, members in enumerate(self.groups):
                rows = np.flatnonzero((first == g) if own else (first != g) & (least[:, g] <= np.sqrt(best) * (1 + 1e-9) + 1e-9))
                if not len(rows) or not len(members):
                    continue
                self.counted += len(rows) * len(members)
                d = _squared(x[rows], squares[rows], self.c[members], self.squares[members])
                k = d.argmin(1)
                far, which = d[np.arange(len(rows)), k], members[k]
                closer = (far < best[rows]) | (far == best[rows]) & (which < at[rows])
                best[rows[closer]], at[rows[closer]] = far[closer], which[closer]
        return at


def _squared(x: np.ndarray, xx: np.ndarray, c: np.ndarray, cc: np.ndarray) -> np.ndarray:
    return np.maximum(xx[:, None] + cc[None, :] - 2 * (x @ c.T), 0)


_PARTIAL = "problem int, cluster long, n long, total array<double>, sse double, cosine_sse double, distances long"


def _rows(problem: int, cluster: np.ndarray, n: np.ndarray, total: np.ndarray, *numbers: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(total.ravel()))
    columns = [pa.array(np.full(len(n), problem, np.int32)), pa.array(cluster), pa.array(n), lists, *map(pa.array, numbers)]
    return pa.record_batch(columns, names=["problem", "cluster", "n", "total", "sse", "cosine_sse", "distances"])


def _by_problem(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Of each problem the columns after it, ``total`` as a matrix."""
    of = np.asarray(batch.column(0))
    for problem in np.unique(of).tolist():
        own = batch.filter(pa.array(of == problem))
        columns = [np.asarray(c.flatten()).reshape(own.num_rows, -1) if name == "total" else np.asarray(c) for name, c in zip(own.schema.names, own.columns, strict=True)]
        yield problem, columns[1:]


def _partials(shared, measure: bool):
    """A task's sums by problem and cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        problems = [(i, lo, hi, Grouped(c), np.zeros((len(c), c.shape[1])), np.zeros(len(c), np.int64), np.zeros((2, len(c)))) for i, lo, hi, c in shared.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            every = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            for _, lo, hi, grouped, total, count, errors in problems:
                x = every[:, lo:hi]
                at = grouped.nearest(x)
                order = np.argsort(at, kind="stable")
                own, first = np.unique(at[order], return_index=True)
                total[own] += np.add.reduceat(x[order], first, axis=0)
                count[own] += np.diff([*first, len(order)])
                if measure:
                    c = grouped.c[at]
                    lengths = np.sqrt((x * x).sum(1) * (c * c).sum(1))
                    cosine = np.divide((x * c).sum(1), lengths, out=np.full(len(x), np.nan), where=lengths > 0)
                    for row, e in zip(errors, (((x - c) ** 2).sum(1), (1 - cosine) ** 2), strict=True):
                        row[own] += np.add.reduceat(e[order], first)
        for i, _, _, grouped, total, count, errors in problems:
            met = np.flatnonzero(count)
            counted = np.where(np.arange(len(met)) == 0, grouped.counted, 0)
            for lo in range(0, len(met), AT_ONCE):
                some = met[lo : lo + AT_ONCE]
                yield _rows(i, some, count[some], total[some], *errors[:, some], counted[lo : lo + AT_ONCE])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of the same problem and cluster, added up."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for problem, columns in _by_problem(batch):
            if problem in sums:
                columns = [np.concatenate(pair) for pair in zip(sums[problem], columns, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            own, first = np.unique(columns[0][order], return_index=True)
            sums[problem] = [own, *(np.add.reduceat(c[order], first, axis=0) for c in columns[1:])]
    for problem, columns in sorted(sums.items()):
        yield _rows(problem, *columns)


def _scan(vectors: DataFrame, active: list[tuple[int, Problem, np.ndarray]], measure: bool):
    """A problem and columns of ``_PARTIAL`` in turn, one row a cluster; more than one scan only if the centroids exceed ``LARGEST``."""
    spark, found, batch, size = vectors.sparkSession, [], [], 0
    for i, problem, c in [*active, (None, None, None)]:
        if batch and (i is None or size + c.nbytes > LARGEST):
            shared = spark.sparkContext.broadcast(batch)
            sums = vectors.select("vec").mapInArrow(_partials(shared, measure), _PARTIAL)
            merged = sums.repartition("problem", "cluster").mapInArrow(_merged, _PARTIAL).toArrow()  # one row a centroid
            found += [part for rows in merged.to_batches() if rows.num_rows for part in _by_problem(rows)]
            shared.destroy()
            batch, size = [], 0
        if i is not None:
            batch.append((i, problem.lo, problem.hi, c))
            size += c.nbytes
    return found


def lloyd(vectors: DataFrame, problems: list[Problem], iterations: int) -> list[Fit]:
    """The fit of each problem after at most ``iterations`` rounds, fewer where nothing moves any more.

    vectors: (vec), arrays of doubles of one length, read once an iteration and once to measure. Clusters that lose all
    vectors keep their centroid.
    """
    fits = [Fit(np.array(p.start, float)) for p in problems]
    active = list(range(len(problems)))
    for _ in range(iterations):
        if not active:
            break
        moved = {i: fits[i].centroids.copy() for i in active}
        for i, (own, n, total, _, _, distances) in _scan(vectors, [(i, problems[i], fits[i].centroids) for i in active], False):
            moved[i][own] = total / n[:, None]
            fits[i].distances += int(distances.sum())
        still = []
        for i in active:
            fits[i].scans += 1
            if not np.array_equal(moved[i], fits[i].centroids):
                still.append(i)
            fits[i].centroids = moved[i]
        active = still
    for i, (_, _, _, sse, cosine_sse, distances) in _scan(vectors, [(i, p, fits[i].centroids) for i, p in enumerate(problems)], True):
        fits[i].sse += float(sse.sum())
        fits[i].cosine_sse += float(cosine_sse.sum())
        fits[i].distances += int(distances.sum())
    return fits


def starts(vectors: DataFrame, most: int, seed: int = 0, key: str = "docid", column: str = "embedding") -> np.ndarray:
    """The vectors of the ``most`` rows whose keys have the least hash; a start for k is the first k of them."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")).cast("binary"))
    rows = V.usable(vectors, column).select(order.alias("order"), F.col(key).cast("string").alias("key"), V.doubles(F.col(column)).alias("vec")).orderBy("order", "key").limit(most)
    return np.array([r.vec for r in rows.collect()], float)
