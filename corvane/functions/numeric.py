"""Scalar helpers on numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded double; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clipped value. Null out NaN first: NaN sorts above every number."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def log_softmax(scores: Column) -> Column:
    """Stable log-softmax over an array of logits."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
    return F.transform(scores, lambda s: s - top - F.log(total))


def argmax(scores: Column) -> Column:
    """0-based position of the first largest entry."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def log1p_target(c: Column) -> Column:
    return F.log1p(c)


def expm1_target(c: Column) -> Column:
    return F.expm1(c)
