"""Numeric functions as column expressions, all in natural logs and doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def xlnx(x: Column) -> Column:
    """``x ln x``, 0 at 0."""
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def h(x: Column) -> Column:
    """``(1 + x) ln(1 + x) - x ln x``."""
    return (1 + x) * F.log1p(x) - xlnx(x)


def lgamma(x: Column) -> Column:
    """Log of the gamma function for positive ``x`` by Stirling's series; arguments under 16 are raised by 8 first.

    Null, zero and negative arguments give null.
    """
    x = x.cast("double")

    def series(z: Column) -> Column:
        inverse = 1 / z
        square = inverse * inverse
        tail = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188))))
        return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + tail

    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return F.when(x >= 16, series(x)).when(x > 0, series(x + 8) - F.ln(product))


def lfactorial(n: Column) -> Column:
    return lgamma(n + 1)


def lbinom(n: Column, k: Column) -> Column:
    """Log of n over k; 0 where n or k is 0 or k is over n."""
    n, k = n.cast("double"), k.cast("double")
    return F.when((n == 0) | (k == 0) | (k > n), F.lit(0.0)).otherwise(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1))


def pairs(n: Column) -> Column:
    """Unordered pairs among ``n``."""
    return n.cast("double") * (n.cast("double") - 1) / 2
