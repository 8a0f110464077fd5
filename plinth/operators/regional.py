"""Comparison of groups along a panel metric, and whether their gaps narrow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.numbers import pct_change, ratio
from plinth.operators import asof


def group_panel(panel: DataFrame, group: str, sum_metrics: Sequence[str]) -> DataFrame:
    """(metric, group, date, value): sums for volumes, means for the rest."""
    additive = F.col("metric").isin(list(sum_metrics)) if sum_metrics else F.lit(False)
    return panel.where("value IS NOT NULL").groupBy("metric", group, "date").agg(
        F.sum("value").alias("s"), F.avg("value").alias("m")) \
        .select("metric", group, "date", F.when(additive, F.col("s")).otherwise(F.col("m")).alias("value"))


def compare(panel: DataFrame, group: str, sum_metrics: Sequence[str] = ()) -> DataFrame:
    """Latest and first level, change, year on year, peak and share for every group of every metric.

    ``ranked_by`` names the ranking column: year-on-year when at least two groups have it.
    """
    cells = group_panel(panel, group, sum_metrics)
    keys = ["metric", group]
    base = cells.groupBy(*keys).agg(
        F.max_by("value", "date").alias("latest"), F.min_by("value", "date").alias("first"),
        F.max("value").alias("peak"), F.max("date").alias("date"), F.count("*").alias("periods"))
    asked = base.select(*keys, "date").withColumn("target", F.add_months("date", -12))
    yoy = asof.nearest(asked, cells, keys, "target", "date", "value", days=25).select(*keys, "base")
    metric = Window.partitionBy("metric")
    additive = F.col("metric").isin(list(sum_metrics)) if sum_metrics else F.lit(False)
    out = base.join(yoy, keys).select(
        *keys, "latest", "first", pct_change("latest", "first").alias("change_pct"),
        F.when(F.col("periods") > 1, pct_change("latest", "base")).alias("yoy_pct"), "peak",
        pct_change("latest", "peak").alias("from_peak_pct"))
    return out.withColumn("share_pct", F.when(additive, ratio("latest", F.sum("latest").over(metric)) * 100)) \
              .withColumn("ranked_by", F.when(F.count("yoy_pct").over(metric) >= 2, "yoy_pct").otherwise("change_pct"))


def leaders_and_laggards(table: DataFrame, group: str, n: int = 5) -> DataFrame:
    """The n strongest and the n weakest groups per metric (weakest first); missing growth sorts last."""
    key = F.when(F.col("ranked_by") == "yoy_pct", F.col("yoy_pct")).otherwise(F.col("change_pct"))
    metric = Window.partitionBy("metric")
    ranked = table.withColumn("growth", key) \
        .withColumn("r", F.row_number().over(metric.orderBy(F.desc_nulls_last("growth"), group))) \
        .withColumn("n", F.count("*").over(metric))
    top = ranked.where(F.col("r") <= n).select("metric", F.lit("leader").alias("side"), F.col("r").alias("place"),
                                               group, "growth")
    low = ranked.where(F.col("r") > F.col("n") - n).select(
        "metric", F.lit("laggard").alias("side"), (F.col("n") - F.col("r") + 1).cast("int").alias("place"),
        group, "growth")
    return top.unionByName(low)


def spread(table: DataFrame) -> DataFrame:
    """Dispersion (sample deviation) and ratio of the latest levels per metric."""
    out = table.groupBy("metric").agg(
        F.count("latest").alias("groups"),
        (ratio(F.stddev_samp("latest"), F.avg("latest")) * 100).alias("dispersion_pct"),
        F.when(F.min("latest") > 0, F.max("latest") / F.min("latest")).alias("spread_ratio"))
    return out.where("groups >= 2")


def convergence(panel: DataFrame, group: str, sum_metrics: Sequence[str] = ()) -> DataFrame:
    """Coefficient of variation across groups by date, first against second half of the history.

    Levels are carried forward, so every group counts from its first observation on.
    """
    cells = group_panel(panel, group, sum_metrics)
    dates = cells.groupBy("metric").agg(F.sort_array(F.collect_set("date")).alias("dates"))
    starts = cells.groupBy("metric", group).agg(F.min("date").alias("a"))
    spine = starts.join(dates, "metric").select(
        "metric", group, F.explode(F.filter("dates", lambda d: d >= F.col("a"))).alias("date"))
    carried = F.last("value", True).over(
        Window.partitionBy("metric", group).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    full = spine.join(cells, ["metric", group, "date"], "left").withColumn("value", carried)
    cv = full.groupBy("metric", "date").agg(
        ratio(F.stddev_samp("value"), F.avg("value")).alias("cv"), F.count("value").alias("n")).where("cv IS NOT NULL")
    metric = Window.partitionBy("metric")
    halves = cv.withColumn("r", F.row_number().over(metric.orderBy("date"))).withColumn("k", F.count("*").over(metric))
    early = F.col("r") <= F.floor(F.col("k") / 2)
    out = halves.groupBy("metric").agg(
        F.max("k").alias("periods"), F.max("n").alias("groups"),
        F.avg(F.when(early, F.col("cv"))).alias("first_half"),
        F.avg(F.when(~early, F.col("cv"))).alias("second_half"))
    change = pct_change("second_half", "first_half")
    usable = (F.col("periods") >= 4) & (F.col("groups") >= 3)
    return out.select(
        "metric", "periods", "groups", "first_half", "second_half", change.alias("change_pct"),
        F.when(~usable | change.isNull(), "unclear").when(change < -8, "converging")
         .when(change > 8, "diverging").otherwise("stable").alias("convergence"))
