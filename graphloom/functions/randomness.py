"""Random numbers that are functions of a seed and keys.

The same whole-number arithmetic runs in any SQL engine, so a draw can be
repeated and checked anywhere, and a task that is run again draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime; all intermediate products stay inside a signed 64-bit number.
PRIME = 2147483647


def uniform(seed: int, *keys: Column) -> Column:
    """A number strictly between 0 and 1 for each combination of up to three whole-number keys."""
    factors = (48271, 69621, 40692)
    total = F.lit(seed % PRIME).cast("long")
    for key, factor in zip(keys, factors, strict=False):
        total = total + F.pmod(key.cast("long"), F.lit(PRIME)) * factor
    prime = F.lit(PRIME).cast("long")
    x = F.pmod(total, prime)
    y = F.pmod(x * x + x * 16807, prime)
    return (F.pmod(y * y + y * 48271, prime) + 0.5) / float(PRIME)


def uniform_sql(seed: int, *keys: str) -> str:
    """The same as SQL text, for an engine whose ``%`` keeps the dividend's sign; keys must not be negative."""
    factors = (48271, 69621, 40692)
    total = " + ".join([str(seed % PRIME), *[f"(({k}) % {PRIME}) * {f}" for k, f in zip(keys, factors, strict=False)]])
    x = f"(({total}) % {PRIME})"
    y = f"(({x} * {x} + {x} * 16807) % {PRIME})"
    return f"((({y} * {y} + {y} * 48271) % {PRIME}) + 0.5) / {float(PRIME)}"


def race(weight: Column, u: Column) -> Column:
    """Exponential-race key: the row with the least key of a group is drawn with probability proportional to its weight."""
    return F.when(weight > 0, -F.ln(u) / weight)
