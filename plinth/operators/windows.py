"""Window operators over series and bounded tables.

A *series* is one row per period and key, so a partition holds at most the number of
periods; rows of adverts are aggregated to periods before any of these run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.numbers import pct_change, ratio


def by_time(keys: Sequence[str], date: str = "date"):
    return Window.partitionBy(*keys).orderBy(date)


def share_within(df: DataFrame, value: str, keys: Sequence[str], out: str = "share_pct") -> DataFrame:
    """Percent of the total of ``value`` inside ``keys``, over an aggregated table."""
    return df.withColumn(out, ratio(F.col(value) * 100.0, F.sum(value).over(Window.partitionBy(*keys))))


def lagged(df: DataFrame, keys: Sequence[str], periods: int = 1, value="value", date="date") -> DataFrame:
    """Value ``periods`` rows back, difference and percent change (missing values are not filled)."""
    before = F.lag(value, periods).over(by_time(keys, date))
    return df.withColumn("previous", before).withColumn("difference", F.col(value) - before) \
             .withColumn("change_pct", pct_change(value, before))


def centred_mean(df: DataFrame, keys: Sequence[str], width: int, value="value", date="date",
                 out="centred") -> DataFrame:
    """Centred rolling mean over what is there; an even width leans one row back."""
    back, ahead = width // 2, (width - 1) // 2
    return df.withColumn(out, F.avg(value).over(by_time(keys, date).rowsBetween(-back, ahead)))


def trailing_mean(df: DataFrame, keys: Sequence[str], value="value", date="date", out="moving") -> DataFrame:
    """Trailing mean of min(12, max(3, n/4)) rows, needing two values."""
    whole = Window.partitionBy(*keys)
    n = F.count("*").over(whole)
    width = F.least(F.lit(12), F.greatest(F.lit(3), F.floor(n / 4)))
    frame = by_time(keys, date).rowsBetween(-11, 0)
    recent = F.reverse(F.collect_list(F.struct(F.col(value).alias("v"))).over(frame))
    values = F.filter(F.transform(F.slice(recent, F.lit(1), width.cast("int")), lambda s: s["v"]),
                      lambda v: v.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)
    return df.withColumn(out, F.when(F.size(values) >= 2, mean))


def filled(df: DataFrame, keys: Sequence[str], value="value", date="date") -> DataFrame:
    """Last known value carried forward, next known value carried backward."""
    w = by_time(keys, date)
    return df.withColumn("forward", F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))) \
             .withColumn("backward", F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing)))


def chained(df: DataFrame, keys: Sequence[str], rate_pct="value", date="date", out="chained") -> DataFrame:
    """Cumulative product of (1 + rate/100)."""
    w = by_time(keys, date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.exp(F.sum(F.log1p(F.col(rate_pct) / 100.0)).over(w)))


def endpoints(df: DataFrame, keys: Sequence[str], value="value", date="date") -> DataFrame:
    """First, previous and latest value, and where the extremes sit (earliest wins)."""
    rows = df.where(F.col(value).isNotNull())
    r = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(date))))
    return r.groupBy(*keys).agg(
        F.min_by(value, date).alias("first"), F.max(F.when(F.col("__r") == 2, F.col(value))).alias("previous"),
        F.max_by(value, date).alias("latest"),
        F.min_by(date, F.struct(value, date)).alias("low_at"),
        F.max_by(date, F.struct(F.col(value), F.negative(F.unix_date(date)))).alias("peak_at"))


def ytd_base(df: DataFrame, keys: Sequence[str], value="value", date="date") -> DataFrame:
    """Last observation of the calendar year before the latest one, and the change from it."""
    rows = df.where(F.col(value).isNotNull())
    r = rows.withColumn("__y", F.year(F.max(date).over(Window.partitionBy(*keys))) - 1)
    prior = F.year(date) == F.col("__y")
    return r.groupBy(*keys).agg(
        F.max_by(value, F.when(prior, F.col(date))).alias("base"), F.max_by(value, date).alias("latest")) \
        .withColumn("ytd_pct", pct_change("latest", "base"))


def rebased(df: DataFrame, keys: Sequence[str], value="value", date="date", out="rebased") -> DataFrame:
    """First value = 100; NULL when the base is zero."""
    base = F.first(value).over(by_time(keys, date).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, ratio(F.col(value), base) * 100)


def month_spine(df: DataFrame, keys: Sequence[str], date="month", step: str = "1 month") -> DataFrame:
    """Every period between the first and the last of each key."""
    ends = df.groupBy(*keys).agg(F.min(date).alias("__a"), F.max(date).alias("__b"))
    return ends.select(*keys, F.explode(F.expr(f"sequence(__a, __b, interval {step})")).alias(date))


def missing_periods(df: DataFrame, keys: Sequence[str], date="month", step: str = "1 month") -> DataFrame:
    """Periods of the spine with no observation."""
    have = df.select(*keys, date).distinct()
    return month_spine(have, keys, date, step).join(have, [*keys, date], "left_anti")


def gap_islands(missing: DataFrame, keys: Sequence[str], date="month") -> DataFrame:
    """Runs of consecutive missing months as (start, end, months)."""
    index = F.year(date) * 12 + F.month(date)
    runs = missing.withColumn("__run", index - F.row_number().over(by_time(keys, date)))
    return runs.groupBy(*keys, "__run").agg(F.min(date).alias("gap_start"), F.max(date).alias("gap_end"),
                                            F.count("*").alias("months")).drop("__run")


def deviation_from_mean(df: DataFrame, keys: Sequence[str], value="value", out="deviation_pct") -> DataFrame:
    """Percent distance from the mean of the partition."""
    return df.withColumn(out, pct_change(value, F.avg(value).over(Window.partitionBy(*keys))))


def collapsed_runs(df: DataFrame, keys: Sequence[str], kind: str, date="date", last: int = 8) -> DataFrame:
    """First row of every run of equal ``kind``, the last ``last`` of them per key."""
    before = F.lag(kind).over(by_time(keys, date))
    firsts = df.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col(kind))).drop("__b")
    return firsts.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(date)))) \
                 .where(F.col("__r") <= last).drop("__r")


def latest_periods(df: DataFrame, period: str, n: int = 3) -> DataFrame:
    """Rows of the ``n`` latest distinct periods."""
    keep = df.select(period).distinct().orderBy(F.desc(period)).limit(n)
    return df.join(F.broadcast(keep), period, "left_semi")
