"""Log of the number of restricted integer partitions, for degree-corrected description lengths."""

from __future__ import annotations

from functools import cache
from math import lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this n the count is exact.
EXACT = 60


def dilog(x: np.ndarray) -> np.ndarray:
    """The dilogarithm of numbers from 0 to 1, by its series on the half where it converges fast."""
    x = np.asarray(x, float)
    small = np.where(x <= 0.5, x, 1 - x)
    total, power = np.zeros_like(small), np.ones_like(small)
    for k in range(1, 60):
        power = power * small
        total += power / (k * k)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.where((x > 0) & (x < 1), np.log(np.maximum(x, 1e-300)) * np.log(np.maximum(1 - x, 1e-300)), 0.0)
    return np.where(x <= 0.5, total, np.pi**2 / 6 - logs - total)


@cache
def partitions(n: int, parts: int) -> int:
    """Partitions of ``n`` into at most ``parts`` parts, exactly."""
    ways = [1] + [0] * n
    for size in range(1, min(n, parts) + 1):
        for total in range(size, n + 1):
            ways[total] += ways[total - size]
    return ways[n]


def log_partitions(n: int, parts: int, exact: int = EXACT) -> float:
    """Log of ``partitions``: exact for small n, the asymptotic forms beyond; 0 for no parts or nothing to split."""
    if n <= 0 or parts < 1:
        return 0.0
    parts = min(parts, n)
    if n <= exact:
        return log(partitions(n, parts))
    if parts < n**0.25:  # few parts: nearly all orders differ
        return lgamma(n) - lgamma(parts) - lgamma(n - parts + 1) - lgamma(parts + 1)
    u = parts / n**0.5
    v, change = u, 1.0
    while change > 1e-8:
        after = u * float(np.sqrt(dilog(np.array(-np.expm1(-v)))))
        v, change = after, abs(after - v)
    e = np.exp(-v)
    lead = log(v) - np.log1p(-e * (1 + u * u / 2)) / 2 - 1.5 * log(2) - log(u) - log(np.pi)
    return float(lead - log(n) + n**0.5 * (2 * v / u - u * np.log1p(-e)))


def log_partitions_col(n: Column, parts: Column, exact: int = EXACT) -> Column:
    """``log_partitions`` on columns, in Arrow batches; apply it to distinct pairs."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([log_partitions(int(x), int(y), exact) for x, y in zip(a, b, strict=True)])

    return run(n.cast("long"), parts.cast("long"))
