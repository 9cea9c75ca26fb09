"""Whitening of vectors by LOBPCG: the leading eigenvectors of a covariance that is never formed.

Vectors become whole numbers; their count and sums are exact. Each iteration is one pass over the rows: a task centres
its rows and multiplies them with a block of at most 3 x ``BLOCK`` columns, and back, and the sums of these products are
all that reaches the driver (components of a vector x columns of the block). There a Rayleigh-Ritz step on the iterate, the
residuals and the previous directions gives the next iterate, until the residual of each wanted pair is below
``RESIDUAL`` of the largest eigenvalue: |V x - e x| bounds what an eigenvalue is off by. Two more passes then whiten the
rows and measure the covariance of what came out.

Edge cases. Vectors null, or holding null or non-finite components, take no part; nor do those whose length is not the
commonest (ties: the longer). Null or repeated vec_id: each row takes part by itself. Directions without variance, such as
all of equal vectors, of a single one, or beyond the rank, have no component: there are fewer than asked for, or none
(no rows). A deviation that no long holds is null. Empty table: empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Columns of the iterate: the components wanted and as many more, so that a cluster of eigenvalues at the end does no harm.
BLOCK = 16
#: Residual over the largest eigenvalue that certifies a pair, and passes after which an uncertified result is an error.
RESIDUAL, PASSES = 1e-12, 300
#: Share of the total variance below which a direction counts as having none.
NOTHING = 1e-13


def usable(df: DataFrame, column: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) of the rows that take part, x as whole numbers; staged."""
    vec = F.transform(F.col(column), lambda c: c.cast("double"))
    fit = F.forall("vec", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select("vec_id", vec.alias("vec")).where(F.col("vec").isNotNull() & (F.size("vec") > 0)).where(fit)
    rows = staged(rows.select("vec_id", F.transform("vec", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(shift)).alias("x")), "whitening-rows")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (common.d if common else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)


def _sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Count of the rows and exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                s = _matrix(batch).sum(0)
                n, total = n + batch.num_rows, s if total is None else total + s
        if n:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], names=["i", "s", "n"])

    found = rows.select("x").mapInArrow(run, "i long, s long, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return (found[0].n if found else 0), np.array([r.s for r in found], np.int64)


def _exact(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S in whole numbers, wide enough for them."""
    if n * max(1, int(np.abs(x).max(initial=0))) + int(np.abs(sums).max(initial=0)) < 2**62:
        return x * n - sums
    return x.astype(object) * n - sums.astype(object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, rounded once."""
    return (_exact(x, n, sums) / n).astype(float)


def _summed(rows: DataFrame, emit, d: int) -> np.ndarray:
    """Sum over all rows of the matrices that ``emit(x)`` gives for a batch, by row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = emit(_matrix(batch))
                total = m if total is None else total + m
        if total is not None:
            i, j = np.divmod(np.arange(total.size), total.shape[1])
            yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "v"])

    found = rows.select("x").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (np.asarray(found.column(c)) for c in ("i", "j", "v"))
    out = np.zeros((d, int(j.max(initial=-1)) + 1))
    out[i, j] = v
    return out


def products(rows: DataFrame, n: int, sums: np.ndarray):
    """block -> V block, V the covariance (divisor n): one pass over the rows."""

    def times(block: np.ndarray) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast(block)  # components of a vector x 3 BLOCK numbers at most

        def emit(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ shared.value)

        return _summed(rows, emit, block.shape[0]) / n

    return times


def _basis(columns: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """Orthonormal columns that span ``columns`` outside of ``against``; directions lost in rounding go."""
    for _ in range(2):
        if against is not None:
            columns = columns - against @ (against.T @ columns)
        norms = np.sqrt((columns * columns).sum(0))
        columns = columns[:, norms > 0] / norms[norms > 0]
        if columns.shape[1]:
            u, s, _ = np.linalg.svd(columns, full_matrices=False)
            columns = u[:, s > 1e-10 * s[0]]
    return columns


def leading(times, d: int, wanted: int = COMPONENTS, block: int = BLOCK, trace: float | None = None, tolerance: float = RESIDUAL, passes: int = PASSES, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors, residuals) of the ``wanted`` largest pairs of the symmetric V that ``times`` multiplies with.

    V times the iterate and the previous directions follow from products already known, as these are combinations of old
    blocks; only residuals are multiplied anew, one pass an iteration. Every few passes, and to certify, iterate and directions
    are multiplied afresh, so that errors of the combinations do not add up.
    """
    wanted, block = min(wanted, d), min(d, max(block, wanted))
    x = _basis(np.random.default_rng(seed).standard_normal((d, block)))
    vx, p, vp = times(x), np.zeros((d, 0)), np.zeros((d, 0))
    best, since, fresh, used = np.inf, 0, True, 1
    while True:
        e, y = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        e, y = e[::-1], y[:, ::-1]
        x, vx = x @ y, vx @ y
        residual = vx - x * e
        size = np.sqrt((residual * residual).sum(0))
        top = max(abs(e[0]), np.finfo(float).tiny)
        worst = size[:wanted].max() / top
        done = worst <= tolerance or block == d
        if done and fresh or not e[0] > 0:
            return e[:wanted], x[:, :wanted], size[:wanted]
        best, since = (worst, 0) if worst < best / 2 else (best, since + 1)
        if used >= passes or since > 40:
            raise ArithmeticError(f"residuals of {worst:.2g} of the largest eigenvalue after {used} passes")
        if done or used % 8 == 7:  # the iterate's own product again
            x = _basis(x)
            p = _basis(p, x) if p.shape[1] else p
            both, fresh, used = times(np.concatenate([x, p], 1)), True, used + 1
            vx, vp = both[:, : x.shape[1]], both[:, x.shape[1] :]
            continue
        r = _basis(residual[:, size > tolerance * top / 10], np.concatenate([x, p], 1) if p.shape[1] else x)
        if not r.shape[1]:
            r = np.zeros((d, 0))
        vr = times(r) if r.shape[1] else np.zeros((d, 0))
        used, fresh = used + 1, False
        s, vs = np.concatenate([x, r, p], 1), np.concatenate([vx, vr, vp], 1)
        e, y = np.linalg.eigh((s.T @ vs + vs.T @ s) / 2)
        y = y[:, ::-1][:, :block]
        old, x_new, vx_new = x.shape[1], s @ y, vs @ y
        # directions: what the step added to the iterate, made orthonormal beside the new iterate with its product carried along
        step, vstep = s[:, old:] @ y[old:], vs[:, old:] @ y[old:]
        overlap = x_new.T @ step
        step, vstep = step - x_new @ overlap, vstep - vx_new @ overlap
        values, turn = np.linalg.eigh(step.T @ step)
        keep = values > 1e-12 * max(values.max(initial=0), np.finfo(float).tiny)
        p, vp = (m @ turn[:, keep] / np.sqrt(values[keep]) for m in (step, vstep))
        x, vx = x_new, vx_new


def whitened(df: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    spark, kind = df.sparkSession, dict(df.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(df, column)
    n, sums = _sums(rows)
    if not n:
        return spark.createDataFrame([], schema)
    d = len(sums)
    times = products(rows, n, sums)
    squares = lambda x: (_centred(x, n, sums) ** 2).sum(0)[:, None]
    trace = float(_summed(rows, squares, d).sum()) / n
    e, vectors, _ = leading(times, d, components) if trace > 0 else (np.zeros(0), np.zeros((d, 0)), None)
    real = e > NOTHING * trace
    project, share = vectors[:, real] / np.sqrt(e[real]), e[real] / trace if trace > 0 else e[real]
    k = project.shape[1]
    if not k:
        return spark.createDataFrame([], schema)

    def moments(x: np.ndarray) -> np.ndarray:
        y = _centred(x, n, sums) @ project
        return np.concatenate([y.sum(0)[None], y.T @ y])

    found = _summed(rows, moments, k + 1) / n
    error = float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            exact = _exact(x, n, sums)
            if exact.dtype == object or d * int(np.abs(exact).max()) ** 2 >= 2**63:
                deviation = [v if v < 2**63 else None for v in (exact.astype(object) ** 2).sum(1).tolist()]
            else:
                deviation = (exact * exact).sum(1).tolist()
            m = len(x)
            at = pa.array(np.repeat(np.arange(m), k))
            y = _centred(x, n, sums) @ project
            yield pa.record_batch(
                [batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviation, pa.int64()).take(at), pa.array(y.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
