"""As-of and interval joins as bucketed equi joins.

The date axis is cut into buckets as wide as the window, each left row visits the one
or two buckets its window touches, and the join itself is an equi join on (keys,
bucket): it shuffles on those keys, spreads a hot key over its buckets and is open to
AQE's skew handling.  No nested loop, whatever the size of either side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _window_join(left: DataFrame, right: DataFrame, keys: Sequence[str], low, high, right_date: str,
                 width: int, how: str = "inner") -> DataFrame:
    bucket = lambda d: F.floor(F.unix_date(d) / F.lit(width))
    l = left.withColumn("__low", low).withColumn("__high", high)
    l = l.withColumn("__b", F.explode_outer(F.sequence(bucket(F.col("__low")), bucket(F.col("__high")))))
    r = right.where(F.col(right_date).isNotNull()).withColumn("__b", bucket(F.col(right_date)))
    r = r.select(*[F.col(k).alias(f"__r_{k}") if k in (*keys, "__b") else F.col(k) for k in r.columns])
    cond = F.col(right_date).between(F.col("__low"), F.col("__high"))
    for key in (*keys, "__b"):
        cond = cond & (F.col(key) == F.col(f"__r_{key}"))
    return l.join(r, cond, how).drop(*[f"__r_{k}" for k in (*keys, "__b")])


def _each_row(left: DataFrame, right: DataFrame, keys: Sequence[str], low, high, width: int, *best) -> DataFrame:
    """``left`` with aggregates of the ``right`` rows (keys, __rd, __rv) in its window, NULL where there are none.

    The left side is computed once: its rows travel through the join and are never joined back by their
    values, since a mean that is computed again may differ in its last bits.  Equal rows stay as many.
    """
    counted = left.groupBy(*left.columns).agg(F.count("*").alias("__copies"))
    found = _window_join(counted, right, keys, low, high, "__rd", width, "left")
    out = found.groupBy(*left.columns, "__copies").agg(*best)
    return out.withColumn("__copies", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], target: str, right_date: str, value: str,
            days: int, out: str = "base") -> DataFrame:
    """Value of ``right`` closest to ``target`` within +/- ``days``; a tie takes the earlier date.

    Left rows without a match keep NULL.
    """
    r = right.select(*keys, F.col(right_date).alias("__rd"), F.col(value).alias("__rv"))
    gap = F.when(F.col("__rd").isNotNull(), F.struct(F.abs(F.date_diff("__rd", F.col(target))).alias("gap"), F.col("__rd")))
    return _each_row(left, r, keys, F.date_sub(target, days), F.date_add(target, days), 2 * days + 1,
                     F.min_by("__rv", gap).alias(out))


def backward(left: DataFrame, right: DataFrame, keys: Sequence[str], target: str, right_date: str, value: str,
             days: int, out: str = "rate") -> DataFrame:
    """Latest value dated on or at most ``days`` before ``target``, with the date it was in force."""
    r = right.select(*keys, F.col(right_date).alias("__rd"), F.col(value).alias("__rv"))
    return _each_row(left, r, keys, F.date_sub(target, days), F.col(target), days + 1,
                     F.max_by("__rv", "__rd").alias(out), F.max("__rd").alias(f"{out}_date"))


def quarter_end_rates(quarters: DataFrame, rates: DataFrame, today, days: int = 10) -> DataFrame:
    """Rate in force at each quarter's last day, looking back over holidays.

    ``quarters`` has column ``quarter`` (first day); quarters that have not ended by
    ``today`` are left out, quarters without a rate in the window too.
    """
    ends = quarters.select("quarter", F.date_sub(F.add_months("quarter", 3), 1).alias("quarter_end")).distinct() \
        .where(F.col("quarter_end") <= F.lit(today).cast("date"))
    return backward(ends, rates, [], "quarter_end", "rate_date", "rate", days).where("rate IS NOT NULL")


def within_months(breaks: DataFrame, events: DataFrame, keys: Sequence[str], break_date: str, event_date: str,
                  months: int = 9) -> DataFrame:
    """First event (in date, title order) at most ``months`` x 31 days from each break."""
    days = months * 31
    renamed = events.select(F.col(event_date).alias("__ed"), F.col("title").alias("__title"))
    found = _window_join(breaks, renamed, [], F.date_sub(break_date, days), F.date_add(break_date, days), "__ed",
                         2 * days + 1)
    return found.groupBy(*keys, break_date).agg(
        F.min(F.struct("__ed", "__title")).alias("e"), F.count("*").alias("candidates")) \
        .select(*keys, break_date, F.col("e.__ed").alias("event_date"), F.col("e.__title").alias("title"),
                "candidates")
