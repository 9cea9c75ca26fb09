"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a text, in lower case, and their first 4, 5 and 6 letters, each a 64-bit hash. The
score is the logistic of a bias, a weight for each term, and the inner product of the terms' factors for each pair of
terms, so that two terms together can say what neither says alone (an insult and the group it is aimed at). All
pairs are summed in linear time: half of the squared sum of factors minus the sum of their squares.

The machine is fitted on a sample of labelled rows of at most ``MOST`` rows of each class, the least by a hash of
the id; scoring covers every row and the whole of each text. The model holds terms of the sample alone, so its size is
bounded by the sample and not by the table: those that tell the classes apart by themselves, and those that do so only
with another. For the latter all pairs of terms in at least ``FREQUENT`` of the sample are tried, a block of terms against a block in
a task: a pair counts if the share of toxic rows with both, with neither, and with one of them is not what adding up would
give. A pair of rarer terms meets too seldom in the sample to be told from chance.

Edge cases. Null or empty text, or one without known terms: the score of the bias. A label row that is null is
left out; an id with several label rows is toxic if one says so; a labelled id on several document rows gives its
least text. No labels, or of one class only: every score is the smoothed share of the class. Repeated rows: each is
scored. Empty table: empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_rest, free, staged

#: Labelled rows of each class at most; share of the sample from which on a term's pairs are tried; rows that a term must be in.
MOST, FREQUENT, LEAST = 5_000, 0.05, 4
#: Deviations from chance of a term that tells by itself, and of a pair; rows with both, either alone, and neither that a pair must have.
SINGLE, PAIR, CELL = 3, 6, 20
#: Terms of a block of pairs.
BLOCK = 512
FACTORS, EPOCHS, BATCH, RATE, SHRINK = 8, 25, 256, 0.1, 1e-5
PREFIXES = (4, 5, 6)
#: Words whose terms a worker remembers; it forgets all beyond that.
REMEMBERED = 400_000

_WORDS = re.compile(r"\w+").findall


def hashes(word: str) -> list[int]:
    """Of a word: its term and those of its beginnings."""
    return [xxhash.xxh64_intdigest("=" + word)] + [xxhash.xxh64_intdigest(f"{n}{word[:n]}") for n in PREFIXES if len(word) >= n]


def terms(text: str | None) -> np.ndarray:
    return np.unique(np.array([h for w in set(_WORDS((text or "").lower())) for h in hashes(w)], np.uint64))


@dataclass
class Machine:
    """terms: sorted hashes; weights and factors by place."""

    bias: float
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def places(self, found: np.ndarray) -> np.ndarray:
        if not len(self.terms) or not len(found):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, found), len(self.terms) - 1)
        return at[self.terms[at] == found]

    def score(self, places: np.ndarray) -> float:
        v = self.factors[places]
        s = v.sum(axis=0)
        z = self.bias + float(self.weights[places].sum()) + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(places: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray, seed: int = 1) -> Machine:
    """AdaGrad on the logistic loss. places: of each document's terms among ``chosen``, the model's terms, sorted.

    Places may be of any integer type; a batch alone is widened.
    """
    y = np.asarray(labels, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Machine(prior)
    place = np.concatenate(places)
    starts = np.cumsum([0, *map(len, places)])
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), FACTORS)), prior
    gw, gv, gb = np.full(len(chosen), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(places))
        for lo in range(0, len(order), BATCH):
            batch = order[lo : lo + BATCH]
            size = starts[batch + 1] - starts[batch]
            row = np.repeat(np.arange(len(batch)), size)
            p = place[np.repeat(starts[batch], size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)].astype(np.int64)
            s = np.stack([np.bincount(row, v[p, f], len(batch)) for f in range(FACTORS)], 1)
            q = np.bincount(row, (v[p] ** 2).sum(axis=1), len(batch))
            score = b + np.bincount(row, w[p], len(batch)) + 0.5 * ((s * s).sum(axis=1) - q)
            g = (1 / (1 + np.exp(-np.clip(score, -60, 60))) - y[batch]) / len(batch)
            used, p = np.unique(p, return_inverse=True)
            dw = np.bincount(p, g[row], len(used)) + SHRINK * w[used]
            dv = np.stack([np.bincount(p, g[row] * (s[row, f] - v[used[p], f]), len(used)) for f in range(FACTORS)], 1) + SHRINK * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += g.sum() ** 2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= 0.2 * RATE * dv / np.sqrt(gv[used])
            b -= RATE * g.sum() / np.sqrt(gb)
    return Machine(float(b), chosen, w, v)


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", learns: Column | None = None, most: int = MOST) -> DataFrame:
    """(id, y, terms) of the sample, staged: at most 2 * ``most`` rows."""
    learns = crc_rest(F.col("doc_id")) != 0 if learns is None else learns
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learns).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    few = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(few[0].unionAll(few[1])), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.record_batch([pa.array([str(x) for x in batch.column(0).to_pylist()]), batch.column(1), pa.array(found, pa.binary())], names=["id", "y", "terms"])

    return staged(chosen.select("doc_id", "y", "text").mapInArrow(run, "id string, y int, terms binary"), "toxicity-sample")


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", frequent: float = FREQUENT, **how) -> Machine:
    """The machine of a sample. Terms are counted on the workers; collected are the chosen ones, bounded by the sample, and of
    each row their places."""
    rows = sample(docs, labels, label, **how)
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or toxic in (0, n):
        return fit([], np.full(n, int(bool(toxic))), np.zeros(0, np.uint64))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(t.as_py(), np.uint64) for t in batch.column(1)]
            y = np.repeat(np.asarray(batch.column(0)), [len(f) for f in found])
            every, at = np.unique(np.concatenate(found), return_inverse=True)
            yield pa.record_batch([pa.array(every.view(np.int64)), pa.array(np.bincount(at, minlength=len(every))), pa.array(np.bincount(at, weights=y, minlength=len(every)).astype(np.int64))], names=["term", "n", "pos"])

    rate = toxic / n
    spread = F.sqrt(F.col("n") * F.lit(rate * (1 - rate)))
    found = rows.select("y", "terms").mapInArrow(counts, "term long, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    telling = (F.col("n") >= LEAST) & (F.abs(F.col("pos") - F.col("n") * rate) >= SINGLE * spread)
    often = F.col("n") >= max(LEAST, frequent * n)
    kept = found.where(telling | often).select("term", telling.alias("telling"), often.alias("often")).collect()
    sorted_ = lambda which: np.sort(np.array([r.term for r in kept if which(r)], np.int64).view(np.uint64))
    of_pairs = interacting(rows, sorted_(lambda r: r.often))
    chosen = np.union1d(sorted_(lambda r: r.telling), of_pairs)
    few = _placed(rows, chosen)
    return fit([p for p, _ in few], np.array([y for _, y in few]), chosen)


def _placed(rows: DataFrame, chosen: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Of each row of the sample the places of the ``chosen`` terms, and y; in the order of ids."""
    model, narrow = rows.sparkSession.sparkContext.broadcast(Machine(0.0, chosen)), np.min_scalar_type(len(chosen))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = model.value
            kept = [m.places(np.frombuffer(t.as_py(), np.uint64)).astype(narrow).tobytes() for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(kept, pa.binary())], names=["id", "y", "places"])

    few = sorted(rows.mapInArrow(own, "id string, y int, places binary").collect())
    return [(np.frombuffer(r.places, narrow), r.y) for r in few]


def interacting(rows: DataFrame, often: np.ndarray) -> np.ndarray:
    """Those of the sorted terms ``often`` that tell the classes apart together with another: see ``PAIR``.

    Broadcast: places of these terms in the sample, bounded by it.
    """
    if len(often) < 2:
        return often[:0]
    spark, few = rows.sparkSession, _placed(rows, often)
    y = np.array([y for _, y in few], np.float32)
    shared = spark.sparkContext.broadcast((np.concatenate([p for p, _ in few]), np.cumsum([0, *(len(p) for p, _ in few)]), y))
    blocks = -(-len(often) // BLOCK)

    def block(k: int) -> np.ndarray:
        place, starts, y = shared.value
        of = np.repeat(np.arange(len(y)), np.diff(starts))
        place = place.astype(np.int32)  # narrower where the terms are few
        own = place // BLOCK == k
        out = np.zeros((len(y), BLOCK), np.float32)
        out[of[own], place[own] % BLOCK] = 1
        return out

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = shared.value[2]
        for batch in batches:
            for pair in batch.column(0).to_pylist():
                i, j = divmod(pair, blocks)
                if i > j:
                    continue
                a, b = block(i), block(j)
                deviating = np.abs(contrast(a, b, y)) >= PAIR
                places = np.unique(np.concatenate([np.flatnonzero(deviating.any(1)) + i * BLOCK, np.flatnonzero(deviating.any(0)) + j * BLOCK]))
                yield pa.record_batch([pa.array(places)], names=["place"])

    found = spark.range(0, blocks * blocks, 1, blocks * blocks).mapInArrow(tried, "place long").distinct().collect()
    return often[np.sort(np.array([r.place for r in found], np.int64))]


def contrast(a: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each column of ``a`` with each of ``b``: the toxic share with both, less that with either alone, plus that with neither, in its deviations.

    0 where one of these has fewer than ``CELL`` rows.
    """
    shares, spread, enough = 0.0, 0.0, True
    n, pos = a.T @ b, (a * y[:, None]).T @ b
    na, nb, pa_, pb = a.sum(0)[:, None], b.sum(0)[None], (a * y[:, None]).sum(0)[:, None], (b * y[:, None]).sum(0)[None]
    for sign, count, toxic in ((1, n, pos), (-1, na - n, pa_ - pos), (-1, nb - n, pb - pos), (1, len(y) - na - nb + n, y.sum() - pa_ - pb + pos)):
        p = (toxic + 0.5) / (count + 1)
        shares, spread = shares + sign * p, spread + p * (1 - p) / (count + 1)
        enough &= count >= CELL
    return np.where(enough, shares / np.sqrt(spread), 0.0)


def scored(docs: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    if column in docs.columns:
        raise ValueError(f"{column} is a column already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = model.value, {}
        index = {int(t): i for i, t in enumerate(m.terms)}
        bias_only = m.score(np.zeros(0, np.int64))

        def places(word: str) -> tuple[int, ...]:
            if (got := known.get(word)) is None:
                if len(known) > REMEMBERED:
                    known.clear()
                got = known[word] = tuple(index[h] for h in hashes(word) if h in index)
            return got

        for batch in batches:
            scores = []
            for text in batch.column("text"):
                at = {p for w in set(_WORDS((text.as_py() or "").lower())) for p in places(w)}
                scores.append(m.score(np.array(sorted(at), np.int64)) if at else bias_only)
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, column])

    schema = ", ".join(f"`{c}` {t}" for c, t in [*docs.dtypes, (column, "double")])
    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    out = scored(docs.select("doc_id", "text"), fitted(docs, labels, label))
    return out.select("doc_id", F.coalesce(crc_rest(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """``docs`` without the rows that the machine finds toxic."""
    (column,) = free(docs, "_toxicity")
    return scored(docs, fitted(docs, labels, label), column).where(F.col(column) < 0.5).drop(column)
