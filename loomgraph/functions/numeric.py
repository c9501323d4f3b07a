"""Scalar expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities closer to 0 or 1 than this count as this far from them in a divergence.
KL_EPS = 1e-10


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def uniform(*keys: Column | str | int | float) -> Column:
    """A number in [0, 1) that depends on the keys alone, so that retries and repartitioning draw the same.

    It is the first 52 bits of the MD5 digest of the keys as text, apart by the unit separator, which any other engine can redo. Null keys are passed over.
    """
    cols = [(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cols)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def uniform_sql(*keys: str) -> str:
    """The DuckDB expression that draws the same; the keys are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws(chr(31), {', '.join(keys)})), 1, 13))::BIGINT::DOUBLE / {1 << 52})"


def pick(values: Column, *keys: Column | str | int) -> Column:
    """An element of the array that depends on the keys alone; null from an empty array."""
    return F.try_element_at(values, F.floor(uniform(*keys) * F.size(values)).cast("int") + 1)


def bernoulli_kl(p: Column, q: Column) -> Column:
    """Divergence of Bernoulli(p) from Bernoulli(q), natural logarithm."""
    p, q = clip(p, KL_EPS, 1 - KL_EPS), clip(q, KL_EPS, 1 - KL_EPS)
    return p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))


def wasserstein(a: Column, b: Column) -> Column:
    """W1 of two arrays of equal size; null for empty ones."""
    gaps = F.zip_with(F.array_sort(a), F.array_sort(b), lambda x, y: F.abs(x - y).cast("double"))
    return F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x), F.size(a))


def safe_corr(x: str, y: str) -> Column:
    """Pearson's r; null where either has no spread."""
    return F.when((F.count(x) > 1) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
