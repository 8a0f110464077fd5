"""The tidy panel: one row per (date, region, segment, metric)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.numbers import to_number

# Roles that add up over regions and time, grain limits, role priority.
SUM_ROLES = {"volume", "supply", "population"}
GRAIN_LIMITS = [(2, "daily"), (10, "weekly"), (45, "monthly"), (135, "quarterly"), (200, "semi-annual")]
PERIODS_PER_YEAR = {"daily": 365, "weekly": 52, "monthly": 12, "quarterly": 4, "semi-annual": 2, "annual": 1}
GRAIN_TARGET = {"daily": "quarter", "weekly": "quarter", "monthly": "quarter", "semi-annual": "year"}
PRICE_METRICS = ["price_usd", "price_per_sqm_usd"]
REPORT_ROLES = [
    "price_per_sqm", "price", "volume", "supply", "mortgage", "rate", "income", "inflation", "fx", "population",
    "area", "value",
]
MIN_QUARTER_ADVERTS = 120
HEADLINE_ROLES = ["price_per_sqm", "price", "volume", "supply", "mortgage", "income", "value"]


def melt(df: DataFrame, date: str, metrics: Sequence[str], region: str | None = None, segment: str | None = None,
         source: str = "table") -> DataFrame:
    """Wide table to tidy rows; undated rows and missing values are dropped."""
    wide = df.where(F.col(date).isNotNull()).select(
        F.col(date).alias("date"),
        (F.trim(F.col(region).cast("string")) if region else F.lit("National")).alias("region"),
        (F.trim(F.col(segment).cast("string")) if segment else F.lit("All")).alias("segment"),
        *[to_number(m).alias(m) for m in metrics])
    return wide.unpivot(["date", "region", "segment"], list(metrics), "metric", "value") \
        .where("value IS NOT NULL").withColumn("source_table", F.lit(source))


def merge_supporting(primary: DataFrame, *others: DataFrame) -> DataFrame:
    """Add metrics the panel does not have yet; the first table to bring a metric wins."""
    out = primary
    for other in others:
        known = out.select("metric").distinct()
        out = out.unionByName(other.join(known, "metric", "left_anti"))
    return out


def grain_of(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Grain per key from the median gap between distinct dates."""
    days = df.where(F.col(date).isNotNull()).select(*keys, date).distinct()
    gap = F.date_diff(date, F.lag(date).over(Window.partitionBy(*keys).orderBy(date)))
    out = days.withColumn("gap", gap).groupBy(*keys).agg(
        F.count("*").alias("periods"), F.percentile("gap", 0.5).alias("median_gap"))
    return out.withColumn("grain", grain_label(F.col("median_gap"), F.col("periods")))


def grain_label(median_gap: Column, periods: Column) -> Column:
    label = F.lit("annual")
    for limit, name in reversed(GRAIN_LIMITS):
        label = F.when(median_gap <= limit, name).otherwise(label)
    return F.when(periods < 2, "single period").otherwise(label)


def periods_per_year(grain: Column) -> Column:
    out = F.lit(12)
    for name, n in PERIODS_PER_YEAR.items():
        out = F.when(grain == name, n).otherwise(out)
    return out


def regrain(panel: DataFrame, sum_metrics: Sequence[str], to: str = "quarter") -> DataFrame:
    """Collapse to quarters or years: sums for volumes, means for the rest.

    A volume that reports nothing for a period inside its own range counts as zero
    there; a mean over nothing stays absent.
    """
    keys = ["region", "segment", "metric"]
    grouped = panel.groupBy(*keys, F.trunc("date", to).alias("date")).agg(
        F.sum("value").alias("s"), F.avg("value").alias("m"))
    additive = F.col("metric").isin(list(sum_metrics)) if sum_metrics else F.lit(False)
    sums = grouped.where(additive)
    ends = sums.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    step = "3 months" if to == "quarter" else "12 months"
    spine = ends.select(*keys, F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("date"))
    dense = spine.join(sums, [*keys, "date"], "left").select(
        "date", *keys, F.coalesce("s", F.lit(0.0)).alias("value"))
    return dense.unionByName(grouped.where(~additive).select("date", *keys, F.col("m").alias("value")))


def national_series(panel: DataFrame, sum_metrics: Sequence[str]) -> DataFrame:
    """One value per metric and date over all regions."""
    additive = F.col("metric").isin(list(sum_metrics)) if sum_metrics else F.lit(False)
    return panel.groupBy("metric", "date").agg(F.sum("value").alias("s"), F.avg("value").alias("m")) \
        .select("metric", "date", F.when(additive, F.col("s")).otherwise(F.col("m")).alias("value"))


def condense_listing_dates(panel: DataFrame, metrics: Sequence[str] = tuple(PRICE_METRICS),
                           minimum: int = MIN_QUARTER_ADVERTS) -> DataFrame:
    """Listing rows to quarters carrying enough adverts; empty below three such quarters."""
    rows = panel.withColumn("date", F.trunc("date", "quarter")).where(F.col("metric").isin(list(metrics)))
    per_metric = rows.groupBy("date", "metric").agg(F.count("*").alias("n"))
    kinds = per_metric.agg(F.greatest(F.count_distinct("metric"), F.lit(1))).scalar()
    kept = per_metric.groupBy("date").agg((F.sum("n") / kinds).alias("adverts")) \
        .where(F.col("adverts") >= minimum)
    kept = kept.withColumn("quarters", F.count("*").over(Window.partitionBy(F.lit(0)))).where("quarters >= 3")
    return rows.join(kept.select("date"), "date", "left_semi")


def usable_series(panel: DataFrame, keys: Sequence[str] = ("metric",), minimum: int = 3) -> DataFrame:
    """Series with at least three observations."""
    long_enough = panel.groupBy(*keys).agg(F.count("value").alias("n")).where(F.col("n") >= minimum)
    return panel.join(long_enough.select(*keys), list(keys), "left_semi")


def pick_headline(series: DataFrame, roles: DataFrame) -> DataFrame:
    """The headline metric: role priority, then the longest, then by name."""
    order = F.array(*[F.lit(r) for r in HEADLINE_ROLES])
    pos = F.array_position(order, F.col("role"))
    rank = F.when(pos > 0, pos).otherwise(len(HEADLINE_ROLES) + 1)
    lengths = series.groupBy("metric").agg(F.count("value").alias("n")).join(roles, "metric", "left")
    return lengths.withColumn("rank", rank).orderBy("rank", F.desc("n"), "metric").limit(1) \
        .select("metric", "role", "n")


def pick_activity(series: DataFrame, roles: DataFrame, exclude: str | Column) -> DataFrame:
    """The series standing for market activity: volume before supply, then the longest."""
    rank = F.when(F.col("role") == "volume", 0).when(F.col("role") == "supply", 1)
    lengths = series.groupBy("metric").agg(F.count("value").alias("n")).join(roles, "metric")
    return lengths.withColumn("rank", rank).where(F.col("rank").isNotNull() & (F.col("metric") != exclude)) \
        .orderBy("rank", F.desc("n"), "metric").limit(1).select("metric", "role", "n")


def aligned(panel: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metrics side by side on one date axis (an outer alignment)."""
    return panel.groupBy("date").pivot("metric", list(metrics)).agg(F.max("value"))


def keep_last(rows: DataFrame, keys: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """One row per key, the last by ``order`` (the larger value on a tie)."""
    return rows.groupBy(*keys).agg(F.max(F.struct(order, value)).alias("r")).select(
        *keys, F.col(f"r.{order}").alias(order), F.col(f"r.{value}").alias(value))


def regularised(series: DataFrame, keys: Sequence[str], step: str = "month") -> DataFrame:
    """A series without holes: period means on a spine, holes filled by straight lines.

    Taken only when fewer than a quarter of the periods are holes; otherwise the
    observations are returned as they are.
    """
    keys = list(keys)
    clean = series.where("value IS NOT NULL").groupBy(*keys, "date").agg(F.avg("value").alias("value"))
    means = clean.groupBy(*keys, F.trunc("date", step).alias("date")).agg(F.avg("value").alias("value"))
    ends = means.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    gap = {"month": "1 month", "quarter": "3 months", "year": "12 months"}[step]
    spine = ends.select(*keys, F.explode(F.expr(f"sequence(a, b, interval {gap})")).alias("date"))
    full = spine.join(means, [*keys, "date"], "left")
    whole = Window.partitionBy(*keys)
    full = full.withColumn("__holes", F.avg(F.col("value").isNull().cast("double")).over(whole)) \
               .withColumn("__n", F.count("value").over(whole))
    dense = interpolated(full, keys).where("__holes < 0.25 AND __n > 3").select(*keys, "date", "value")
    sparse = clean.join(full.where("__holes >= 0.25 OR __n <= 3").select(*keys).distinct(), keys, "left_semi")
    return dense.unionByName(sparse.select(*keys, "date", "value"))


def interpolated(df: DataFrame, keys: Sequence[str], value: str = "value", date: str = "date") -> DataFrame:
    """Straight line by position between known neighbours; the ends are held flat."""
    w = Window.partitionBy(*keys).orderBy(date)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("__p").alias("p"), F.col(value).alias("v")))
    rows = df.withColumn("__p", F.row_number().over(w)) \
             .withColumn("__lo", F.last(known, True).over(back)).withColumn("__hi", F.first(known, True).over(ahead))
    share = F.try_divide(F.col("__p") - F.col("__lo.p"), F.col("__hi.p") - F.col("__lo.p"))
    line = F.col("__lo.v") + (F.col("__hi.v") - F.col("__lo.v")) * share
    return rows.withColumn(value, F.coalesce(F.col(value), line, F.col("__lo.v"), F.col("__hi.v"))) \
               .drop("__p", "__lo", "__hi")


def role_order(df: DataFrame, role: str = "role", name: str = "metric") -> DataFrame:
    """Rows in order of how central their role is to a housing market."""
    order = F.array(*[F.lit(r) for r in REPORT_ROLES])
    pos = F.array_position(order, F.col(role))
    return df.withColumn("role_rank", F.when(pos > 0, pos).otherwise(len(REPORT_ROLES) + 1)) \
             .orderBy("role_rank", name)
