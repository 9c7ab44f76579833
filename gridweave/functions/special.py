"""Functions that Spark has no built-in for: special ones, used on the driver for single numbers, and division."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) for a chi-square variable: the regularised upper incomplete gamma function Q(df/2, x/2)."""
    if not x > 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower function
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    # continued fraction of the upper one
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def divided(x: Column, y: Column) -> Column:
    """x / y of doubles as IEEE 754 and DuckDB have it: a divisor of 0 gives an infinity of the signs' product, 0 / 0 NaN."""
    return F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(F.try_divide(x, y))
