"""Series analytics for every key at once: summary, trend, breaks, turns, projection.

Input is a series table (keys, date, value), one row per period, so any window
partition is as long as the history of one series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.numbers import growth_per_year, pct_change, ratio, years_between
from plinth.operators import asof
from plinth.operators.order_stats import join_on
from plinth.operators.panel import grain_of, periods_per_year

# Thresholds that are part of the results.
MIN_SEGMENT, MAX_BREAKS, MIN_GAIN, MIN_SHIFT_PCT = 4, 3, 0.25, 3.0
SEASONAL_STRENGTH = 0.3
PP_ROLES = ["rate", "inflation"]


def _order(keys, date="date"):
    return Window.partitionBy(*keys).orderBy(date)


def _upto_now(keys):
    return _order(keys).rowsBetween(Window.unboundedPreceding, 0)


def direction_label(change: Column) -> Column:
    return (F.when(change.isNull(), "flat").when(change > 15, "rising sharply").when(change > 3, "rising")
            .when(change < -15, "falling sharply").when(change < -3, "falling").otherwise("broadly flat"))


def momentum_label(current: Column, previous: Column) -> Column:
    gap = current - previous
    return F.when(gap > 2, "accelerating").when(gap < -2, "decelerating").otherwise("stable")


def yoy_base(series: DataFrame, keys: Sequence[str], points: DataFrame, days: int = 20) -> DataFrame:
    """``points`` (keys, date, value) with ``base``: the value nearest to one year earlier."""
    asked = points.withColumn("target", F.add_months("date", -12))
    return asof.nearest(asked, series, keys, "target", "date", "value", days)


def summary(series: DataFrame, keys: Sequence[str], roles: DataFrame | None = None) -> DataFrame:
    """Levels, growth, spread and labels, one row per series.

    ``roles`` (keys, role) marks rates, whose changes are also given in points.
    """
    keys = list(keys)
    rows = series.where("value IS NOT NULL").select(*keys, "date", "value")
    whole, time = Window.partitionBy(*keys), _order(keys)
    rows = rows.withColumn("ret", ratio("value", F.lag("value").over(time)) - 1) \
               .withColumn("back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))) \
               .withColumn("prior_year", F.year("date") == F.year(F.max("date").over(whole)) - 1)
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("observations"), F.min("date").alias("start"), F.max("date").alias("end"),
        F.min_by("value", "date").alias("first_value"), F.max_by("value", "date").alias("latest"),
        F.max(F.when(F.col("back") == 2, F.col("value"))).alias("previous"),
        F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum"),
        F.min_by("date", F.struct("value", "date")).alias("min_date"),
        F.min_by("date", F.struct(F.negative("value"), F.col("date"))).alias("max_date"),
        F.stddev_samp("value").alias("std"), F.stddev_samp("ret").alias("ret_sd"), F.count("ret").alias("rets"),
        F.max_by("value", F.when(F.col("prior_year"), F.col("date"))).alias("ytd_base"))
    points = rows.where("back <= 2").select(*keys, "date", "value", "back")
    yoy = yoy_base(rows.select(*keys, "date", "value"), keys, points).groupBy(*keys).agg(
        F.max(F.when(F.col("back") == 1, F.col("base"))).alias("base_1"),
        F.max(F.when(F.col("back") == 2, F.col("base"))).alias("base_2"))
    grain = grain_of(rows, keys).select(*keys, "grain")
    out = join_on(join_on(base, yoy, keys), grain, keys)
    out = join_on(out, roles, keys) if roles is not None else out.withColumn("role", F.lit("value"))
    in_points = F.col("role").isin(PP_ROLES)
    out = (
        out.withColumn("period_change_pct", pct_change("latest", "previous"))
        .withColumn("total_change_pct", pct_change("latest", "first_value"))
        .withColumn("yoy_pct", pct_change("latest", "base_1"))
        .withColumn("yoy_prev_pct", pct_change("previous", "base_2"))
        .withColumn("ytd_pct", pct_change("latest", "ytd_base"))
        .withColumn("cagr_pct", growth_per_year("first_value", "latest", years_between("start", "end")))
        .withColumn("volatility_pct", F.when(F.col("rets") > 2, F.col("ret_sd") * F.sqrt(
            periods_per_year(F.col("grain"))) * 100))
        .withColumn("pct_from_peak", pct_change("latest", "maximum"))
        .withColumn("change_unit", F.when(in_points, "pp").otherwise("%"))
        .withColumn("yoy_pp", F.when(in_points, F.col("latest") - F.col("base_1")))
        .withColumn("period_change_pp", F.when(in_points, F.col("latest") - F.col("previous")))
        .withColumn("direction", direction_label(F.coalesce("yoy_pct", "total_change_pct")))
        .withColumn("momentum", momentum_label(F.col("yoy_pct"), F.col("yoy_prev_pct")))
    )
    return out.drop("ret_sd", "rets", "ytd_base", "base_1", "base_2")


def positioned(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Zero-based position of each observation and the series length."""
    return series.where("value IS NOT NULL").withColumn("pos", F.row_number().over(_order(keys)) - 1) \
        .withColumn("n", F.count("*").over(Window.partitionBy(*keys)))


def trend(series: DataFrame, keys: Sequence[str], per_year: int = 12, with_p: bool = True) -> DataFrame:
    """Least-squares line over the position, for series of four or more points."""
    rows = positioned(series, keys).where("n >= 4").withColumn("x", F.col("pos").cast("double"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("value", "x").alias("slope_per_period"),
        F.regr_r2("value", "x").alias("r_squared"), F.avg("value").alias("mean"))
    out = out.withColumn("slope_per_year_pct", ratio(F.col("slope_per_period") * per_year, "mean") * 100)
    if with_p:
        from plinth.functions.student_t import r_p_value
        out = out.withColumn("p_value", r_p_value(F.sqrt("r_squared"), "n")) \
                 .withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))
    return out.drop("mean")


def year_on_year(series: DataFrame, keys: Sequence[str], per_year: int = 12) -> DataFrame:
    """Percent change over a fixed lag of one year; only series longer than a year."""
    rows = positioned(series, keys).where(F.col("n") > per_year)
    return rows.withColumn("yoy_pct", pct_change("value", F.lag("value", per_year).over(_order(keys)))) \
               .where("yoy_pct IS NOT NULL").select(*keys, "date", "yoy_pct")


def seasonal_effects(series: DataFrame, keys: Sequence[str], per_year: int = 12) -> DataFrame:
    """Mean distance from the centred moving average by calendar month or quarter, with its strength."""
    label = F.month("date") if per_year == 12 else F.quarter("date")
    frame = _order(keys).rowsBetween(-(per_year // 2), (per_year - 1) // 2)
    whole = Window.partitionBy(*keys)
    rows = positioned(series, keys).where(F.col("n") >= 2 * per_year) \
        .withColumn("d", F.col("value") - F.avg("value").over(frame))
    rows = rows.withColumn("strength", F.try_divide(F.var_pop("d").over(whole), F.var_pop("value").over(whole)))
    return rows.groupBy(*keys, label.alias("season")).agg(
        F.avg("d").alias("effect"), F.max("strength").alias("strength")) \
        .withColumn("detected", F.col("strength") > SEASONAL_STRENGTH)


def breakpoints(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Level shifts by binary segmentation: at most three, each explaining a quarter of its segment.

    The gain of splitting a segment after i of n points is i (n-i) / n times the squared
    difference of the two means, so one running sum per round prices every split.
    """
    keys = list(keys)
    rows = positioned(series, keys).where(F.col("n") >= 2 * MIN_SEGMENT + 1)
    rows = rows.select(*keys, "date", "value", "pos", F.lit(0).alias("seg"), F.lit(True).alias("open"),
                       F.lit(None).cast("int").alias("cut_order"))
    per_key = Window.partitionBy(*keys)
    for step in range(1, MAX_BREAKS + 1):
        segment = Window.partitionBy(*keys, "seg")
        before = segment.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        i = F.col("pos") - F.col("seg")
        rows = rows.withColumn("len", F.count("*").over(segment)) \
                   .withColumn("total", F.sum("value").over(segment)) \
                   .withColumn("left", F.coalesce(F.sum("value").over(before), F.lit(0.0))) \
                   .withColumn("ss", F.var_pop("value").over(segment) * F.col("len"))
        left_mean = F.try_divide(F.col("left"), i)
        right_mean = F.try_divide(F.col("total") - F.col("left"), F.col("len") - i)
        gain = i * (F.col("len") - i) / F.col("len") * F.pow(left_mean - right_mean, 2)
        allowed = F.col("open") & (i >= MIN_SEGMENT) & (i < F.col("len") - MIN_SEGMENT)
        candidate = F.when(allowed & (gain > 0), F.struct(
            gain.alias("gain"), F.negative("pos").alias("back"), "seg", "ss"))
        rows = rows.withColumn("best", F.max(candidate).over(per_key))
        accept = F.coalesce((F.col("best.ss") > 0) & (F.col("best.gain") >= MIN_GAIN * F.col("best.ss")), F.lit(False))
        cut = F.negative(F.col("best.back"))
        rows = rows.withColumn("open", F.col("open") & accept) \
            .withColumn("cut_order", F.when(accept & (F.col("pos") == cut), step).otherwise(F.col("cut_order"))) \
            .withColumn("seg", F.when(accept & (F.col("seg") == F.col("best.seg")) & (F.col("pos") >= cut), cut)
                        .otherwise(F.col("seg"))) \
            .drop("len", "total", "left", "ss", "best")
    time = _order(keys, "pos")
    out = rows.withColumn("before_mean", F.avg("value").over(time.rowsBetween(-12, -1))) \
              .withColumn("after_mean", F.avg("value").over(time.rowsBetween(0, 11))) \
              .where("cut_order IS NOT NULL") \
              .withColumn("shift_pct", pct_change("after_mean", "before_mean"))
    return out.where(F.abs("shift_pct") >= MIN_SHIFT_PCT).select(
        *keys, "date", "before_mean", "after_mean", "shift_pct",
        F.when(F.col("shift_pct") > 0, "step up").otherwise("step down").alias("direction"))


def turning_points(series: DataFrame, keys: Sequence[str], per_year: int = 12, last: int = 8) -> DataFrame:
    """Peaks and troughs of the smoothed level, runs of one kind collapsed to their first."""
    from plinth.operators.windows import centred_mean, collapsed_runs
    w = max(3, per_year // 2)
    rows = centred_mean(positioned(series, keys).where(F.col("n") >= 2 * w + 1), keys, w, out="s")
    left, right = _order(keys).rowsBetween(-w, -1), _order(keys).rowsBetween(1, w)
    rows = rows.withColumn("lmax", F.max("s").over(left)).withColumn("lmin", F.min("s").over(left)) \
               .withColumn("rmax", F.max("s").over(right)).withColumn("rmin", F.min("s").over(right))
    peak = (F.col("s") >= F.col("lmax")) & (F.col("s") >= F.col("rmax"))
    trough = (F.col("s") <= F.col("lmin")) & (F.col("s") <= F.col("rmin"))
    marked = rows.where((F.col("pos") >= w) & (F.col("pos") < F.col("n") - w)) \
        .withColumn("kind", F.when(peak, "peak").when(trough, "trough")).where("kind IS NOT NULL")
    return collapsed_runs(marked.select(*keys, "date", "kind", "value"), keys, "kind", last=last)


def line_projection(series: DataFrame, keys: Sequence[str], horizon: int, step: str = "month") -> DataFrame:
    """Straight-line extrapolation with a widening 95 % band, for six or more points."""
    months = {"month": 1, "quarter": 3, "year": 12}[step]
    rows = positioned(series, keys).where("n >= 6").withColumn("x", F.col("pos").cast("double")) \
        .withColumn("diff", F.col("value") - F.lag("value").over(_order(keys)))
    fit = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("date").alias("end"), F.regr_slope("value", "x").alias("b"),
        F.regr_intercept("value", "x").alias("a"), F.stddev_pop("diff").alias("sd"))
    ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    middle = F.col("a") + F.col("b") * (F.col("n") + F.col("step") - 1)
    band = F.lit(1.96) * F.col("sd") * F.sqrt("step")
    return ahead.select(*keys, "step", F.add_months("end", F.col("step") * months).alias("date"),
                        middle.alias("forecast"), (middle - band).alias("lower"), (middle + band).alias("upper"))


def real_terms(nominal: DataFrame, deflator: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nominal values deflated by a chained rate or, for larger values, by an index ratio."""
    keys = list(keys)
    joined = nominal.select(*keys, "date", F.col("value").alias("nominal")).where("nominal IS NOT NULL").join(
        deflator.select(*keys, "date", F.col("value").alias("infl")).where("infl IS NOT NULL"), [*keys, "date"])
    time = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date")
    so_far = time.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    chained = F.exp(F.sum(F.log1p(F.col("infl") / 100)).over(so_far))
    rows = joined.withColumn("is_rate", F.percentile(F.abs("infl"), 0.5).over(whole) < 60)
    rows = rows.withColumn("level", F.when(F.col("is_rate"), chained).otherwise(F.col("infl")))
    rows = rows.withColumn("deflator", ratio("level", F.first("level").over(so_far)))
    return rows.select(*keys, "date", "nominal", ratio("nominal", "deflator").alias("real"))


def affordability(price: DataFrame, income: DataFrame, keys: Sequence[str] = (), months: int = 12) -> DataFrame:
    """Years of income an average dwelling costs."""
    keys = list(keys)
    return price.select(*keys, "date", F.col("value").alias("price")).join(
        income.select(*keys, "date", F.col("value").alias("income")), [*keys, "date"]) \
        .withColumn("affordability_years", ratio("price", F.col("income") * months)) \
        .where("affordability_years IS NOT NULL")


def month_deviation(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percent distance from the own-year mean, averaged by month of year."""
    year = Window.partitionBy(*keys, F.year("date"))
    rows = series.withColumn("dev", pct_change("value", F.avg("value").over(year)))
    return rows.groupBy(*keys, F.month("date").alias("month")).agg(F.avg("dev").alias("deviation_pct"))


def common_support(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two series cut to the dates both of them span."""
    ends = lambda df: df.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    lo = F.greatest(ends(a).select("lo").scalar(), ends(b).select("lo").scalar())
    hi = F.least(ends(a).select("hi").scalar(), ends(b).select("hi").scalar())
    left = a.withColumn("series", F.lit("a")).select("series", "date", "value")
    right = b.withColumn("series", F.lit("b")).select("series", "date", "value")
    return left.unionByName(right).where(F.col("date").between(lo, hi))
