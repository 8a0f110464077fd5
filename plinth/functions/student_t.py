"""Two-sided Student-t p-values for small result tables (Spark has no such builtin)."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def two_sided_p(t: float, df: float) -> float:
    if t is None or df is None or not math.isfinite(t) or df <= 0:
        return 0.0 if t is not None and math.isinf(t) else float("nan")
    a, b, x = df / 2.0, 0.5, df / (df + t * t)
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    front = math.exp(log_front)
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """p of |T| >= |t| with ``df`` degrees of freedom."""
    values = [two_sided_p(float(a), float(b)) if a == a and b == b else np.nan for a, b in zip(t, df)]
    return pd.Series(values, dtype="float64").replace({np.nan: None}).astype("float64")


def r_p_value(r, n):
    """p-value column of a correlation ``r`` over ``n`` pairs."""
    r, n = F.col(r) if isinstance(r, str) else r, F.col(n) if isinstance(n, str) else n
    t = F.abs(r) * F.sqrt(F.try_divide(n - 2, F.lit(1.0) - r * r))
    p = t_p_value(t.cast("double"), (n - 2).cast("double"))
    return F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(F.when(~F.isnan(p), p))
