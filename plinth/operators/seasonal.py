"""Per-series numeric fits: robust STL strength and Holt-Winters projection.

Each group handed to Python is one short series (its periods), never a table of adverts;
Spark partitions the series and runs them in parallel.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


def _local_line(y, width, weights, at):
    """Locally weighted line through y (positions 0..n-1), evaluated at ``at``."""
    n = len(y)
    x = np.arange(n, dtype=float)
    q = min(width, n)
    dist = np.abs(at[:, None] - x[None, :])
    reach = np.partition(dist, q - 1, axis=1)[:, q - 1:q]
    reach = reach * (width / n if width > n else 1.0)
    u = np.clip(dist / np.maximum(reach, 1e-12), 0, 1)
    w = np.where(dist <= 0.001 * reach, 1.0, (1 - u ** 3) ** 3) * weights[None, :]
    total = np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
    mean_x = (w * x).sum(axis=1, keepdims=True) / total
    mean_y = (w * y).sum(axis=1, keepdims=True) / total
    sxx = (w * (x - mean_x) ** 2).sum(axis=1, keepdims=True)
    sxy = (w * (x - mean_x) * (y - mean_y)).sum(axis=1, keepdims=True)
    slope = np.where(sxx > 1e-9 * total * n * n, sxy / np.maximum(sxx, 1e-300), 0.0)
    return (mean_y + slope * (at[:, None] - mean_x))[:, 0]


def _odd_above(value: float) -> int:
    whole = int(np.ceil(value))
    return whole if whole % 2 else whole + 1


def stl(y: np.ndarray, period: int, seasonal_width: int = 7, outer: int = 15, inner: int = 2):
    """Seasonal-trend decomposition by local lines with robustness weights (Cleveland et al., 1990)."""
    n = len(y)
    trend_width = _odd_above(1.5 * period / (1 - 1.5 / seasonal_width))
    low_width = _odd_above(period + 1)
    trend, weights = np.zeros(n), np.ones(n)
    seasonal = np.zeros(n)
    mean = lambda a, k: np.convolve(a, np.ones(k) / k, mode="valid")
    positions = np.arange(n, dtype=float)
    for _ in range(outer + 1):
        for _ in range(inner):
            detrended = y - trend
            padded = np.zeros(n + 2 * period)
            for phase in range(period):
                part = detrended[phase::period]
                at = np.arange(-1, len(part) + 1, dtype=float)
                padded[phase::period][:len(at)] = _local_line(part, seasonal_width, weights[phase::period], at)
            low = mean(mean(mean(padded, period), period), 3)
            low = _local_line(low, low_width, np.ones(n), positions)
            seasonal = padded[period:period + n] - low
            trend = _local_line(y - seasonal, trend_width, weights, positions)
        resid = np.abs(y - trend - seasonal)
        scale = 6 * np.median(resid)
        if scale <= 0:
            break
        u = resid / scale
        weights = np.where(u < 1, (1 - u ** 2) ** 2, 0.0)
    return trend, seasonal, y - trend - seasonal


def stl_strength(series: DataFrame, keys: Sequence[str], period: int = 12) -> DataFrame:
    """Seasonal strength max(0, 1 - var(resid) / var(seasonal + resid)), detected above 0.3."""
    schema = ", ".join(f"`{k}` {dict(series.dtypes)[k]}" for k in keys)
    schema += ", periods int, strength double, detected boolean, peak_season int, trough_season int"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["value"]).sort_values("date")
        y = pdf["value"].to_numpy(dtype=float)
        if len(y) < 2 * period:
            return pd.DataFrame()
        _, seasonal, resid = stl(y, period)
        spread = float(np.var(seasonal + resid))
        strength = max(0.0, 1 - float(np.var(resid)) / spread) if spread else 0.0
        months = pd.to_datetime(pdf["date"]).dt.month.to_numpy()
        season = months if period == 12 else (months - 1) // 3 + 1
        effect = pd.Series(seasonal).groupby(season).mean()
        row = {k: pdf[k].iloc[0] for k in keys}
        row.update(periods=len(y), strength=strength, detected=bool(strength > 0.3 and len(effect) > 1),
                   peak_season=int(effect.idxmax()), trough_season=int(effect.idxmin()))
        return pd.DataFrame([row])

    return series.groupBy(*keys).applyInPandas(fit, schema)


def _smooth(y, alpha, beta, gamma, period):
    """One pass of additive exponential smoothing; (sum of squares, level, slope, seasonal)."""
    if gamma is None:
        level, slope, season = y[0], y[1] - y[0], np.zeros(1)
    else:
        level = y[:period].mean()
        slope = (y[period:2 * period].mean() - level) / period
        season = y[:period] - level
    season, sse = season.copy(), 0.0
    k = len(season)
    for i, value in enumerate(y):
        s = season[i % k] if gamma is not None else 0.0
        error = value - (level + slope + s)
        sse += error * error
        before = level
        level = alpha * (value - s) + (1 - alpha) * (level + slope)
        slope = beta * (level - before) + (1 - beta) * slope
        if gamma is not None:
            season[i % k] = gamma * (value - level) + (1 - gamma) * s
    return sse, level, slope, season


def exponential_projection(series: DataFrame, keys: Sequence[str], horizon: int, per_year: int = 12) -> DataFrame:
    """Holt-Winters (or Holt, for shorter histories) with smoothing weights of least squared error.

    The band is 1.96 population deviations of the period differences, widening with the
    square root of the step.
    """
    schema = ", ".join(f"`{k}` {dict(series.dtypes)[k]}" for k in keys)
    schema += ", method string, step int, forecast double, lower double, upper double"
    horizon = max(1, min(horizon, per_year))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["value"]).sort_values("date")
        y = pdf["value"].to_numpy(dtype=float)
        if len(y) < 6:
            return pd.DataFrame()
        seasonal = per_year > 1 and len(y) >= 2 * per_year + 4
        grid = np.linspace(0.05, 0.95, 7)
        best = min(((_smooth(y, a, b * a, g, per_year), a, b, g)
                    for a in grid for b in (0.02, 0.1, 0.3, 0.6)
                    for g in ((0.02, 0.1, 0.3, 0.6) if seasonal else (None,))), key=lambda r: r[0][0])
        _, level, slope, season = best[0]
        sd = float(np.std(np.diff(y)))
        steps = np.arange(1, horizon + 1)
        add = season[(len(y) + steps - 1) % len(season)] if seasonal else 0.0
        middle = level + slope * steps + add
        band = 1.96 * sd * np.sqrt(steps)
        out = pd.DataFrame({"step": steps, "forecast": middle, "lower": middle - band, "upper": middle + band})
        out.insert(0, "method", "holt-winters" if seasonal else "holt")
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return series.groupBy(*keys).applyInPandas(fit, schema)
