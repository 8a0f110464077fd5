"""Null-safe arithmetic: no NaN, no infinity, no ANSI division errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NULL for NaN and the infinities."""
    x = _c(x).cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def to_number(x) -> Column:
    """Text or number to a finite double, NULL when it does not parse."""
    return finite(_c(x).try_cast("double"))


def ratio(a, b) -> Column:
    """a / b, NULL on a zero or missing base."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def pearson(a, b) -> Column:
    """Correlation over the rows that have both values, NULL where either is constant (``corr`` divides by zero there)."""
    both = _c(a).isNotNull() & _c(b).isNotNull()
    spread = F.stddev_pop(F.when(both, _c(a))) * F.stddev_pop(F.when(both, _c(b)))
    return F.try_divide(F.covar_pop(_c(a), _c(b)), spread)


def pct_change(new, old) -> Column:
    """Percent change; NULL when the base is zero, missing or not finite."""
    return (ratio(new, finite(old)) - F.lit(1.0)) * F.lit(100.0)


def years_between(start, end) -> Column:
    return F.date_diff(_c(end), _c(start)) / F.lit(365.25)


def growth_per_year(first, last, years) -> Column:
    """Compound annual growth in percent, for spans of at least nine months."""
    first, last, years = _c(first), _c(last), _c(years)
    ok = (years >= 0.75) & (first > 0) & (last > 0)
    return F.when(ok, (F.pow(F.try_divide(last, first), F.try_divide(F.lit(1.0), years)) - 1.0) * 100.0)


def compact(x) -> Column:
    """1234567 -> '1.2M': K / M / B / T display form."""
    x = _c(x)
    size = F.abs(x)
    out = F.format_number(x, 0)
    for power, letter in ((3, "K"), (6, "M"), (9, "B"), (12, "T")):
        out = F.when(size >= 10.0 ** power,
                     F.concat(F.format_string("%.1f", x / 10.0 ** power), F.lit(letter))).otherwise(out)
    return out


def table_number(x, decimals: int = 1, missing: str = "—") -> Column:
    """Space thousands, comma decimals, a dash for NULL."""
    return F.coalesce(F.translate(F.format_number(_c(x), decimals), ",.", " ,"), F.lit(missing))
