"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def usable(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` whose vector is there, without null or non-finite components."""
    return rows.where(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """NaN where a vector is zero."""
    product = norm(a) * norm(b)
    return F.when(product == 0, F.lit(float("nan"))).otherwise(F.try_divide(dot(a, b), product))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def log_softmax(wanted: Column, other: Column) -> Column:
    """Log share of the first of two logits; shifted by the larger one, so it never overflows."""
    most = F.greatest(wanted, other)
    return wanted - most - F.log(F.exp(wanted - most) + F.exp(other - most))


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors that the mask keeps; zeros where it keeps none, null without tokens."""
    kept = F.filter(F.zip_with(tokens, mask, lambda t, m: F.when(m.cast("boolean"), t)), lambda t: t.isNotNull())
    zero = F.transform(tokens[0], lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, t: F.zip_with(s, doubles(t), lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
