"""Column statistics."""

from __future__ import annotations

from math import exp, lgamma

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 97.5 % quantile of the normal distribution. Fixed value.
Z = 1.959963984540054


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.when(whole > 0, part / whole)


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """Both ends of Wilson's 95 % interval, not clamped; null for n = 0."""
    p = successes / n
    middle, spread = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    width = 1 + Z * Z / n
    return F.when(n > 0, (middle - spread) / width), F.when(n > 0, (middle + spread) / width)


@F.pandas_udf(T.DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p of the 2x2 table ((a, b), (c, d)): the tables no likelier than this one. Null if a count is null."""

    def p(a, b, c, d):
        if any(x != x or x is None for x in (a, b, c, d)):
            return None
        row, col, n = a + b, a + c, a + b + c + d
        low, high = int(max(0, col - (n - row))), int(min(row, col))
        choose = lambda m, k: lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1)
        logs = [choose(row, x) + choose(n - row, col - x) - choose(n, col) for x in range(low, high + 1)]
        here = logs[int(a) - low]
        return min(1.0, sum(exp(x) for x in logs if x <= here + 1e-7))

    return pd.Series([p(*t) for t in zip(a, b, c, d, strict=True)], dtype="float64")
