"""Column expressions that Spark SQL lacks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def col(x: Column | str | float) -> Column:
    """A column, a column's name, or a number as a double."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def safe_ln(p: Column | str) -> Column:
    """Natural logarithm; minus infinity at zero, where Spark has null."""
    return F.when(col(p) > 0, F.ln(col(p))).otherwise(F.lit(NEG_INF))


def lgamma(x: Column | str | float) -> Column:
    """Log-gamma for positive x: Stirling's series ten further on, led back by the product of what lies between."""
    x = col(x)
    z = x + 10
    shift = F.ln(reduce(lambda a, k: a * (x + k), range(1, 10), x))
    i = F.lit(1.0) / (z * z)
    series = (F.lit(1 / 12) - i * (F.lit(1 / 360) - i * (F.lit(1 / 1260) - i * F.lit(1 / 1680)))) / z
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def normal_logpdf(x: Column | str, mu: Column | str | float, sigma: Column | str | float) -> Column:
    d = (col(x) - col(mu)) / col(sigma)
    return -0.5 * math.log(2 * math.pi) - F.ln(col(sigma)) - 0.5 * d * d


def uniform(key: Column, tag: str) -> Column:
    """A uniform number in (0, 1) that depends on the row's key and a tag alone: rows may be dealt out and computed anew in any way."""
    digits = F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(tag))), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(key: Column, tag: str) -> Column:
    """A standard normal number from two uniforms."""
    return F.sqrt(-2 * F.ln(uniform(key, tag + "|r"))) * F.cos(2 * math.pi * uniform(key, tag + "|a"))


def pick(cumulative: Column, u: Column) -> Column:
    """1-based index of the first entry of an ascending array that reaches u; its last one if rounding leaves none."""
    return F.least(F.size(F.filter(cumulative, lambda c: c < u)) + 1, F.size(cumulative)).cast("int")


def alias_table(probs: Sequence[float]) -> tuple[list[float], list[int]]:
    """For each of n equal columns the share that its own state keeps, and the 1-based state that has the rest: a draw is two lookups, however many states."""
    n = len(probs)
    keep, other = [p * n for p in probs], list(range(1, n + 1))
    small, large = [i for i, p in enumerate(keep) if p < 1], [i for i, p in enumerate(keep) if p >= 1]
    while small and large:
        low, high = small.pop(), large[-1]
        other[low] = high + 1
        keep[high] -= 1 - keep[low]
        if keep[high] < 1:
            small.append(large.pop())
    for i in small + large:  # what rounding left
        keep[i] = 1.0
    return keep, other


def alias_pick(keep: Sequence[float], other: Sequence[int], u: Column) -> Column:
    """1-based state of a uniform number: its column, then the state that holds the number's place in it."""
    v = u * len(keep)
    i = F.least(F.floor(v), F.lit(len(keep) - 1)).cast("int")
    arrays = F.expr(f"array({', '.join(f'{x!r}D' for x in keep)})"), F.expr(f"array({', '.join(map(str, other))})")
    return F.when(v - i < F.get(arrays[0], i), i + 1).otherwise(F.get(arrays[1], i)).cast("int")
