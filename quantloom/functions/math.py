"""Protected arithmetic, the normal distribution, and randomness that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def protected_div(a: Column, b: Column) -> Column:
    """One where the divisor is next to zero."""
    return F.when(F.abs(b) > 1e-10, F.try_divide(a, b)).otherwise(1.0)


def protected_sqrt(x: Column) -> Column:
    return F.sqrt(F.abs(x))


def protected_log(x: Column, epsilon: float = 1e-10) -> Column:
    return F.ln(F.abs(x) + epsilon)


def protected_power(x: Column, y: Column) -> Column:
    return F.pow(F.abs(x), y)


def nearly_equal(a: Column, b: Column, within: float = 1e-6) -> Column:
    return F.abs(a - b) < within


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution, absolute error below 1e-7 (Abramowitz and Stegun 26.2.17)."""
    # The coefficients of that approximation.
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + p * F.abs(z))
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the seed and the keys alone, whatever the partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_normal(seed: int, *keys: Column) -> Column:
    """A standard normal number from two uniform ones (Box and Muller)."""
    u, v = hash_uniform(seed, *keys, F.lit("u")), hash_uniform(seed, *keys, F.lit("v"))
    return F.sqrt(-2 * F.ln(u + 1e-12)) * F.cos(2 * F.pi() * v)
