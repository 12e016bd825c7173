"""Arithmetic that never raises: null where a result has no meaning."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.functions.normalize import col


def ratio(num: str | Column, den: str | Column) -> Column:
    """Null on a zero or missing denominator (M1)."""
    return F.when(col(den) != 0, col(num) / col(den))


def log_size(c: str | Column) -> Column:
    """ln(1 + x) of positive values (M2)."""
    return F.when(col(c) > 0, F.log1p(col(c)))


def first_known_sum(*cols: str | Column) -> Column:
    """The sum with missing parts as 0, null if all are missing (M3)."""
    known = F.coalesce(*(col(c) for c in cols)).isNotNull()
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(col(c), F.lit(0.0))
    return F.when(known, total)


def change(now: str | Column, before: str | Column) -> Column:
    """Relative change over the former value's size (M4)."""
    return F.when(col(before) != 0, (col(now) - col(before)) / F.abs(col(before)))


def at_least_zero(c: str | Column) -> Column:
    return F.greatest(col(c), F.lit(0))


def sigmoid(c: str | Column, bound: float = 35.0) -> Column:
    return F.when(col(c).isNotNull(), 1 / (1 + F.exp(-F.greatest(F.least(col(c), F.lit(bound)), F.lit(-bound)))))


def linear_score(intercept: float, weights: dict[str, float]) -> Column:
    """A fixed linear score as a probability; missing inputs make it null (M6)."""
    total = F.lit(float(intercept))
    for c, w in weights.items():
        total = total + F.lit(float(w)) * F.col(c)
    return sigmoid(total)


def z_score(c: str, by: tuple[str, ...]) -> Column:
    """Against the mean and population deviation of a group (M7)."""
    w = Window.partitionBy(*by)
    return ratio(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w))


def finite(c: str | Column, bound: float = 1e12) -> Column:
    """NaN and infinities as null, the rest clipped (P15). Nulls stay, though least and greatest pass over them."""
    x = col(c).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.greatest(F.least(x, F.lit(bound)), F.lit(-bound)))


def half_up(c: str | Column) -> Column:
    """Rounding of non-negative numbers with halves upwards."""
    return F.floor(col(c) + F.lit(0.5).cast("double"))


def task_seed(*parts: object) -> int:
    """A seed from 1 to 2^31 - 2 that depends on a task's name alone (M9)."""
    raw = hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest()
    return int.from_bytes(raw, "big") % (2**31 - 2) + 1


def text_hash(c: str | Column) -> Column:
    return F.sha2(F.coalesce(col(c).cast("string"), F.lit("")), 256)


def uniform_bin(p, n: int = 10):
    """The bin of a probability, by comparison with the bins' own edges."""
    return sum(((p >= F.lit(k / n)).cast("int") for k in range(1, n)), F.lit(0))
