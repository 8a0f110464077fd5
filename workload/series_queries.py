"""Panel building, window functions and series analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import panel as P
from plinth.operators import seasonal, series as S
from plinth.operators import windows as W
from workload.registry import query
from workload.tables import (LISTINGS, NATIONAL, PANEL, listings, monthly_panel, national_panel, quarterly,
                             QUARTERLY, table)

KEYS = ["metric", "region"]
ROLES = [("price", "price"), ("transactions", "volume"), ("income", "income")]
ROLES_SQL = "roles(metric, role) AS (VALUES ('price', 'price'), ('transactions', 'volume'), ('income', 'income'))"


def roles(spark):
    return spark.createDataFrame(ROLES, "metric string, role string")


# ---- panel ------------------------------------------------------------------

@query("pnl_01_melt", doubles="value", sql="""
SELECT CAST(o_orderdate AS DATE) AS date, 'National' AS region, trim(o_orderpriority) AS segment,
  m AS metric, v AS value, 'orders' AS source_table
FROM (SELECT o_orderdate, o_orderpriority, unnest(['o_totalprice', 'o_custkey']) AS m,
  unnest([o_totalprice, CAST(o_custkey AS DOUBLE)]) AS v FROM orders) WHERE v IS NOT NULL""")
def melt(spark, sf):
    orders = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    return P.melt(orders, "d", ["o_totalprice", "o_custkey"], segment="o_orderpriority", source="orders")


@query("pnl_02_merge_supporting", doubles="value", sql="WITH " + NATIONAL + """
SELECT metric, date, value FROM series WHERE metric <> 'income'
UNION ALL SELECT 'suppliers', DATE '2024-01-01', CAST(count(*) AS DOUBLE) FROM supplier""")
def merge_supporting(spark, sf):
    main = national_panel(spark, sf).where("metric <> 'income'")
    n = table(spark, sf, "supplier").agg(F.count("*").cast("double").alias("value"))
    other = n.select(F.explode(F.array(F.lit("suppliers"), F.lit("price"))).alias("metric"),
                     F.lit("2024-01-01").cast("date").alias("date"), "value")
    return P.merge_supporting(main, other)


@query("pnl_03_regrain_quarter", doubles="value", sql="WITH " + PANEL + """,
g AS (SELECT region, segment, metric, CAST(date_trunc('quarter', date) AS DATE) AS date, sum(value) AS s, avg(value) AS m
  FROM panel GROUP BY 1, 2, 3, 4),
spine AS (SELECT region, segment, metric, CAST(unnest(generate_series(a, b, INTERVAL 3 MONTH)) AS DATE) AS date FROM
  (SELECT region, segment, metric, min(date) AS a, max(date) AS b FROM g WHERE metric = 'transactions' GROUP BY 1, 2, 3))
SELECT date, region, segment, metric, coalesce(s, 0) AS value FROM spine LEFT JOIN g USING (region, segment, metric, date)
UNION ALL SELECT date, region, segment, metric, m FROM g WHERE metric <> 'transactions'""")
def regrain(spark, sf):
    return P.regrain(monthly_panel(spark, sf), ["transactions"])


@query("pnl_04_national_series", doubles="value", sql="WITH " + NATIONAL + " SELECT metric, date, value FROM series")
def national(spark, sf):
    return national_panel(spark, sf)


LISTING_ROWS = "WITH " + LISTINGS + """,
rows_ AS (SELECT CAST(date_trunc('quarter', date) AS DATE) AS date, region, 'price_usd' AS metric, price_usd AS value
  FROM listings UNION ALL
  SELECT CAST(date_trunc('quarter', date) AS DATE), region, 'price_per_sqm_usd', sqm_usd FROM listings),
kept AS (SELECT date FROM rows_ GROUP BY date HAVING count(*) / (SELECT count(DISTINCT metric) FROM rows_) >= 120)"""


@query("pnl_05_condense_listing_dates", doubles="value", sql=LISTING_ROWS + """
SELECT date, metric, region, count(*) AS n, avg(value) AS value FROM rows_
WHERE date IN (SELECT date FROM kept) AND (SELECT count(*) FROM kept) >= 3 GROUP BY 1, 2, 3""")
def condense(spark, sf):
    rows = listings(spark, sf).select("date", "region", F.col("price_usd"), F.col("sqm_usd").alias("price_per_sqm_usd"),
                                      "total_area")
    tidy = rows.unpivot(["date", "region"], ["price_usd", "price_per_sqm_usd", "total_area"], "metric", "value")
    return P.condense_listing_dates(tidy).groupBy("date", "metric", "region").agg(
        F.count("*").alias("n"), F.avg("value").alias("value"))


@query("jn_08_semi_join_kept_quarters", sql=LISTING_ROWS + """
SELECT date, count(*) AS n FROM rows_ WHERE date IN (SELECT date FROM kept)
  AND (SELECT count(*) FROM kept) >= 3 GROUP BY 1""")
def semi_join(spark, sf):
    rows = listings(spark, sf).select("date", "region", "price_usd", F.col("sqm_usd").alias("price_per_sqm_usd"))
    tidy = rows.unpivot(["date", "region"], ["price_usd", "price_per_sqm_usd"], "metric", "value")
    return P.condense_listing_dates(tidy).groupBy("date").agg(F.count("*").alias("n"))


@query("pnl_06_headline_metric", sql="WITH " + NATIONAL + ", " + ROLES_SQL + """
SELECT metric, role, n FROM (SELECT metric, count(value) AS n FROM series GROUP BY 1 HAVING count(value) >= 3)
JOIN roles USING (metric) ORDER BY CASE role WHEN 'price' THEN 2 WHEN 'volume' THEN 3 ELSE 6 END, n DESC, metric LIMIT 1""")
def headline(spark, sf):
    return P.pick_headline(P.usable_series(national_panel(spark, sf)), roles(spark))


@query("pnl_06_activity_metric", sql="WITH " + NATIONAL + ", " + ROLES_SQL + """
SELECT metric, role, n FROM (SELECT metric, count(value) AS n FROM series GROUP BY 1 HAVING count(value) >= 3)
JOIN roles USING (metric) WHERE role IN ('volume', 'supply') AND metric <> 'price' ORDER BY n DESC LIMIT 1""")
def activity(spark, sf):
    return P.pick_activity(P.usable_series(national_panel(spark, sf)), roles(spark), "price")


@query("pnl_07_align_metrics", doubles="price transactions income", sql="WITH " + NATIONAL + """
SELECT date, max(value) FILTER (WHERE metric = 'price') AS price,
  max(value) FILTER (WHERE metric = 'transactions') AS transactions,
  max(value) FILTER (WHERE metric = 'income') AS income FROM series GROUP BY date""")
def align(spark, sf):
    return P.aligned(national_panel(spark, sf), ["price", "transactions", "income"])


@query("jn_01_full_outer_dates", doubles="price fx", sql="WITH " + PANEL + """,
a AS (SELECT date, avg(value) AS price FROM panel WHERE metric = 'price' AND region < 'G' GROUP BY 1),
b AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS fx FROM events GROUP BY 1)
SELECT date, price, fx FROM a FULL JOIN b USING (date)""")
def outer(spark, sf):
    a = monthly_panel(spark, sf).where("metric = 'price' AND region < 'G'").groupBy("date").agg(
        F.avg("value").alias("price"))
    b = table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("fx"))
    return a.join(b, "date", "full")


@query("jn_01_full_outer_dates_overlap", doubles="price income", sql="WITH " + PANEL + """,
a AS (SELECT date, avg(value) AS price FROM panel WHERE metric = 'price' AND date < DATE '2000-01-01' GROUP BY 1),
b AS (SELECT date, avg(value) AS income FROM panel WHERE metric = 'income' AND date >= DATE '1997-01-01' GROUP BY 1)
SELECT date, price, income FROM a FULL JOIN b USING (date)""")
def outer_overlap(spark, sf):
    """Two filled ranges that overlap: dates of the left side only, of both, and of the right side only."""
    rows = monthly_panel(spark, sf)
    a = rows.where("metric = 'price' AND date < DATE '2000-01-01'").groupBy("date").agg(F.avg("value").alias("price"))
    b = rows.where("metric = 'income' AND date >= DATE '1997-01-01'").groupBy("date").agg(F.avg("value").alias("income"))
    return a.join(b, "date", "full")


# Holes for the regularising operators: two order months of every eleven are taken out.
HOLEY = PANEL + """,
holey AS (SELECT metric, region, date, value FROM panel
  WHERE (year(date) * 12 + month(date) + length(region)) % 11 > 1 AND metric = 'price'),
spine AS (SELECT metric, region, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS date FROM
  (SELECT metric, region, min(date) AS a, max(date) AS b FROM holey GROUP BY 1, 2)),
dense AS (SELECT metric, region, date, value,
    row_number() OVER (PARTITION BY metric, region ORDER BY date) AS p FROM spine LEFT JOIN holey USING (metric, region, date)),
br AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER lo AS lp,
    last_value(value IGNORE NULLS) OVER lo AS lv,
    first_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER hi AS hp,
    first_value(value IGNORE NULLS) OVER hi AS hv FROM dense
  WINDOW lo AS (PARTITION BY metric, region ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         hi AS (PARTITION BY metric, region ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def holey(spark, sf):
    rows = monthly_panel(spark, sf).where("metric = 'price'")
    return rows.where((F.year("date") * 12 + F.month("date") + F.length("region")) % 11 > 1) \
        .select("metric", "region", "date", "value")


@query("pnl_08_regularise", doubles="value", sql="WITH " + HOLEY + """,
sh AS (SELECT metric, region, avg(CAST(value IS NULL AS INT)) < 0.25 AND count(value) > 3 AS ok FROM dense GROUP BY 1, 2)
SELECT metric, region, date, coalesce(value, lv + (hv - lv) * ((p - lp) * 1.0 / nullif(hp - lp, 0)), lv, hv) AS value
FROM br JOIN sh USING (metric, region) WHERE ok
UNION ALL SELECT metric, region, date, value FROM holey JOIN sh USING (metric, region) WHERE NOT ok""")
def regularise(spark, sf):
    return P.regularised(holey(spark, sf), KEYS)


@query("win_17_linear_interpolation", doubles="value", sql="WITH " + HOLEY + """
SELECT metric, region, date, coalesce(value, lv + (hv - lv) * ((p - lp) * 1.0 / nullif(hp - lp, 0)), lv, hv) AS value
FROM br WHERE value IS NULL""")
def interpolate(spark, sf):
    rows = holey(spark, sf)
    spine = W.month_spine(rows, KEYS, "date")
    full = spine.join(rows, [*KEYS, "date"], "left").withColumn("hole", F.col("value").isNull())
    return P.interpolated(full, KEYS).where("hole").drop("hole")


@query("pnl_09_pivot_groups", doubles="BUILDING AUTOMOBILE MACHINERY", digits=3, sql="WITH " + LISTINGS + """
SELECT CAST(date_trunc('quarter', date) AS DATE) AS date, avg(price_usd) FILTER (WHERE segment = 'BUILDING') AS "BUILDING",
  avg(price_usd) FILTER (WHERE segment = 'AUTOMOBILE') AS "AUTOMOBILE",
  avg(price_usd) FILTER (WHERE segment = 'MACHINERY') AS "MACHINERY" FROM listings GROUP BY 1""")
def pivot_groups(spark, sf):
    return listings(spark, sf).groupBy(F.trunc("date", "quarter").alias("date")) \
        .pivot("segment", ["BUILDING", "AUTOMOBILE", "MACHINERY"]).agg(F.avg("price_usd"))


@query("pnl_10_role_order", sql="WITH " + NATIONAL + ", " + ROLES_SQL + """
SELECT metric, role, n, CAST(CASE role WHEN 'price' THEN 2 WHEN 'volume' THEN 3 ELSE 7 END AS BIGINT) AS role_rank
FROM (SELECT metric, count(*) AS n FROM series GROUP BY 1) JOIN roles USING (metric)""")
def role_order(spark, sf):
    counts = national_panel(spark, sf).groupBy("metric").agg(F.count("*").alias("n"))
    return P.role_order(counts.join(roles(spark), "metric"))


@query("prf_06_grain", doubles="median_gap", sql="WITH " + PANEL + """,
d AS (SELECT DISTINCT metric, region, date FROM panel),
g AS (SELECT metric, region, date - lag(date) OVER (PARTITION BY metric, region ORDER BY date) AS gap FROM d)
SELECT metric, region, count(*) AS periods, quantile_cont(gap, 0.5) AS median_gap,
  CASE WHEN count(*) < 2 THEN 'single period' WHEN quantile_cont(gap, 0.5) <= 2 THEN 'daily'
  WHEN quantile_cont(gap, 0.5) <= 10 THEN 'weekly' WHEN quantile_cont(gap, 0.5) <= 45 THEN 'monthly'
  WHEN quantile_cont(gap, 0.5) <= 135 THEN 'quarterly' WHEN quantile_cont(gap, 0.5) <= 200 THEN 'semi-annual'
  ELSE 'annual' END AS grain FROM g GROUP BY 1, 2""")
def grain(spark, sf):
    return P.grain_of(monthly_panel(spark, sf), KEYS)


# ---- windows ----------------------------------------------------------------

PART = "PARTITION BY metric, region ORDER BY date"


@query("win_01_lag_change", doubles="value previous difference change_pct", sql="WITH " + PANEL + f"""
SELECT metric, region, date, value, lag(value, 3) OVER w AS previous, value - lag(value, 3) OVER w AS difference,
  (value / lag(value, 3) OVER w - 1) * 100 AS change_pct FROM panel WINDOW w AS ({PART})""")
def lag_change(spark, sf):
    return W.lagged(monthly_panel(spark, sf).drop("segment"), KEYS, 3)


@query("win_02_centred_mean", doubles="value centred", sql="WITH " + PANEL + f"""
SELECT metric, region, date, value, avg(value) OVER ({PART} ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS centred FROM panel""")
def centred(spark, sf):
    return W.centred_mean(monthly_panel(spark, sf).drop("segment"), KEYS, 12)


@query("win_03_trailing_mean", doubles="value moving", sql="WITH " + PANEL + f""",
n AS (SELECT *, row_number() OVER ({PART}) AS r,
  least(12, greatest(3, count(*) OVER (PARTITION BY metric, region) // 4)) AS k FROM panel)
SELECT a.metric, a.region, a.date, a.value, CASE WHEN count(b.value) >= 2 THEN avg(b.value) END AS moving
FROM n a JOIN n b ON a.metric = b.metric AND a.region = b.region AND b.r > a.r - a.k AND b.r <= a.r GROUP BY 1, 2, 3, 4""")
def trailing(spark, sf):
    return W.trailing_mean(monthly_panel(spark, sf).drop("segment"), KEYS)


@query("win_04_fill", doubles="value forward backward", sql="WITH " + HOLEY + f"""
SELECT metric, region, date, value, lv AS forward, hv AS backward FROM br""")
def fill(spark, sf):
    rows = holey(spark, sf)
    full = W.month_spine(rows, KEYS, "date").join(rows, [*KEYS, "date"], "left")
    return W.filled(full, KEYS)


@query("win_05_cumulative_product", doubles="rate chained", sql="""
WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_returnflag AS flag, avg(l_tax) AS rate
  FROM lineitem GROUP BY 1, 2)
SELECT date, flag, rate, exp(sum(ln(1 + rate / 100)) OVER (PARTITION BY flag ORDER BY date)) AS chained FROM m""", digits=7)
def chained(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(
        F.trunc(F.to_date("l_shipdate"), "month").alias("date"), F.col("l_returnflag").alias("flag")).agg(
        F.avg("l_tax").alias("rate"))
    return W.chained(rows, ["flag"], "rate")


@query("win_06_endpoints", doubles="first previous latest", sql="WITH " + PANEL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY metric, region ORDER BY date DESC) AS r FROM panel)
SELECT metric, region, arg_min(value, date) AS first, max(value) FILTER (WHERE r = 2) AS previous,
  arg_max(value, date) AS latest, arg_min(date, (value, date)) AS low_at, arg_min(date, (-value, date)) AS peak_at
FROM r GROUP BY 1, 2""")
def endpoints(spark, sf):
    return W.endpoints(monthly_panel(spark, sf), KEYS)


@query("win_07_ytd_base", doubles="base latest ytd_pct", sql="WITH " + PANEL + """,
y AS (SELECT *, year(max(date) OVER (PARTITION BY metric, region)) - 1 AS y FROM panel),
g AS (SELECT metric, region, arg_max(value, date) FILTER (WHERE year(date) = y) AS base, arg_max(value, date) AS latest
  FROM y GROUP BY 1, 2) SELECT *, (latest / base - 1) * 100 AS ytd_pct FROM g""")
def ytd(spark, sf):
    return W.ytd_base(monthly_panel(spark, sf), KEYS)


@query("win_08_rebase", doubles="value rebased", sql="WITH " + PANEL + f"""
SELECT metric, region, date, value, value / first_value(value) OVER ({PART}) * 100 AS rebased FROM panel""")
def rebase(spark, sf):
    return W.rebased(monthly_panel(spark, sf).drop("segment"), KEYS)


MISSING = "WITH " + HOLEY + """,
missing AS (SELECT metric, region, date FROM spine EXCEPT SELECT metric, region, date FROM holey)"""


@query("win_11_missing_periods", sql=MISSING + " SELECT * FROM missing")
def missing(spark, sf):
    return W.missing_periods(holey(spark, sf), KEYS, "date")


@query("win_12_gap_islands", sql=MISSING + """,
i AS (SELECT *, year(date) * 12 + month(date) - row_number() OVER (PARTITION BY metric, region ORDER BY date) AS run FROM missing)
SELECT metric, region, min(date) AS gap_start, max(date) AS gap_end, count(*) AS months FROM i GROUP BY metric, region, run""")
def islands(spark, sf):
    return W.gap_islands(W.missing_periods(holey(spark, sf), KEYS, "date"), KEYS, "date")


@query("win_13_deviation_from_mean", doubles="value deviation_pct", sql="WITH " + PANEL + """
SELECT metric, region, date, value, year(date) AS year,
  (value / avg(value) OVER (PARTITION BY metric, region, year(date)) - 1) * 100 AS deviation_pct FROM panel""")
def deviation(spark, sf):
    rows = monthly_panel(spark, sf).drop("segment").withColumn("year", F.year("date"))
    return W.deviation_from_mean(rows, [*KEYS, "year"])


@query("win_14_collapsed_runs", doubles="value", sql="WITH " + PANEL + f""",
k AS (SELECT metric, region, date, value, CASE WHEN value >= avg(value) OVER (PARTITION BY metric, region)
  THEN 'above' ELSE 'below' END AS kind FROM panel),
b AS (SELECT *, lag(kind) OVER ({PART}) AS b FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY metric, region ORDER BY date DESC) AS r FROM b WHERE b IS NULL OR b <> kind)
SELECT metric, region, date, value, kind FROM f WHERE r <= 8""")
def runs(spark, sf):
    from pyspark.sql import Window
    rows = monthly_panel(spark, sf).drop("segment").withColumn(
        "kind", F.when(F.col("value") >= F.avg("value").over(Window.partitionBy(*KEYS)), "above").otherwise("below"))
    return W.collapsed_runs(rows, KEYS, "kind")


@query("win_15_latest_quarters", doubles="median_usd_sqm median_usd", sql="WITH " + QUARTERLY + """
SELECT * FROM quarterly WHERE quarter IN (SELECT DISTINCT quarter FROM quarterly ORDER BY quarter DESC LIMIT 3)""")
def latest(spark, sf):
    return W.latest_periods(quarterly(spark, sf), "quarter")


# ---- series -----------------------------------------------------------------

NEAR = """
near AS (SELECT a.metric, a.region, a.back, arg_min(b.value, (abs(b.date - a.target), b.date)) AS base
  FROM (SELECT *, CAST(date - INTERVAL 1 YEAR AS DATE) AS target FROM r WHERE back <= 2) a
  JOIN panel b ON a.metric = b.metric AND a.region = b.region AND b.date BETWEEN a.target - 20 AND a.target + 20
  GROUP BY 1, 2, 3)"""
RANKED = """
r AS (SELECT *, row_number() OVER (PARTITION BY metric, region ORDER BY date DESC) AS back,
  value / lag(value) OVER (PARTITION BY metric, region ORDER BY date) - 1 AS ret,
  year(date) = year(max(date) OVER (PARTITION BY metric, region)) - 1 AS py FROM panel)"""
SUMMARY = "WITH " + PANEL + "," + RANKED + "," + NEAR + """,
g AS (SELECT metric, region, count(*) AS observations, min(date) AS start, max(date) AS "end",
  arg_min(value, date) AS first_value, arg_max(value, date) AS latest, max(value) FILTER (WHERE back = 2) AS previous,
  avg(value) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS minimum, max(value) AS maximum,
  arg_min(date, (value, date)) AS min_date, arg_min(date, (-value, date)) AS max_date, stddev_samp(value) AS std,
  stddev_samp(ret) AS rsd, count(ret) AS rets, arg_max(value, date) FILTER (WHERE py) AS yb FROM r GROUP BY 1, 2),
n AS (SELECT metric, region, max(base) FILTER (WHERE back = 1) AS b1, max(base) FILTER (WHERE back = 2) AS b2
  FROM near GROUP BY 1, 2),
t AS (SELECT g.*, (latest / b1 - 1) * 100 AS yoy_pct, (previous / b2 - 1) * 100 AS yoy_prev_pct,
  (latest / first_value - 1) * 100 AS total_change_pct, ("end" - start) / 365.25 AS years
  FROM g LEFT JOIN n USING (metric, region)),
summary AS (SELECT metric, region, observations, start, "end", first_value, latest, previous, mean, median, minimum, maximum, min_date, max_date,
  std, 'monthly' AS grain, 'value' AS role, (latest / previous - 1) * 100 AS period_change_pct, total_change_pct, yoy_pct,
  yoy_prev_pct, (latest / yb - 1) * 100 AS ytd_pct,
  CASE WHEN years >= 0.75 AND first_value > 0 AND latest > 0 THEN (pow(latest / first_value, 1 / years) - 1) * 100 END AS cagr_pct,
  CASE WHEN rets > 2 THEN rsd * sqrt(12) * 100 END AS volatility_pct, (latest / maximum - 1) * 100 AS pct_from_peak,
  '%' AS change_unit, CAST(NULL AS DOUBLE) AS yoy_pp, CAST(NULL AS DOUBLE) AS period_change_pp,
  CASE WHEN coalesce(yoy_pct, total_change_pct) IS NULL THEN 'flat' WHEN coalesce(yoy_pct, total_change_pct) > 15 THEN 'rising sharply'
   WHEN coalesce(yoy_pct, total_change_pct) > 3 THEN 'rising' WHEN coalesce(yoy_pct, total_change_pct) < -15 THEN 'falling sharply'
   WHEN coalesce(yoy_pct, total_change_pct) < -3 THEN 'falling' ELSE 'broadly flat' END AS direction,
  CASE WHEN yoy_pct - yoy_prev_pct > 2 THEN 'accelerating' WHEN yoy_pct - yoy_prev_pct < -2 THEN 'decelerating'
   ELSE 'stable' END AS momentum FROM t)"""


@query("ts_01_series_summary", doubles="first_value latest previous mean median minimum maximum std period_change_pct "
       "total_change_pct yoy_pct yoy_prev_pct ytd_pct cagr_pct volatility_pct pct_from_peak",
       sql=SUMMARY + " SELECT * FROM summary")
def summary(spark, sf):
    return S.summary(monthly_panel(spark, sf), KEYS)


@query("ts_02_direction_momentum", sql=SUMMARY + " SELECT metric, region, direction, momentum FROM summary")
def direction(spark, sf):
    return S.summary(monthly_panel(spark, sf), KEYS).select(*KEYS, "direction", "momentum")


@query("jn_03_nearest_asof_20_days", doubles="value base", sql="WITH " + PANEL + "," + RANKED + "," + NEAR + """
SELECT r.metric, r.region, r.date, r.value, CAST(date - INTERVAL 1 YEAR AS DATE) AS target, base FROM r
LEFT JOIN near ON r.metric = near.metric AND r.region = near.region AND r.back = near.back WHERE r.back = 1""")
def nearest(spark, sf):
    rows = monthly_panel(spark, sf).select(*KEYS, "date", "value")
    last = rows.groupBy(*KEYS).agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))
    return S.yoy_base(rows, KEYS, last.select(*KEYS, "date", "value"))


POS = "WITH " + PANEL + """,
p AS (SELECT metric, region, date, value, row_number() OVER (PARTITION BY metric, region ORDER BY date) - 1 AS pos,
  count(*) OVER (PARTITION BY metric, region) AS n FROM panel)"""


@query("ts_03_linear_trend", doubles="slope_per_period r_squared slope_per_year_pct", sql=POS + """
SELECT metric, region, count(*) AS n, regr_slope(value, pos) AS slope_per_period, regr_r2(value, pos) AS r_squared,
  regr_slope(value, pos) * 12 / avg(value) * 100 AS slope_per_year_pct FROM p WHERE n >= 4 GROUP BY 1, 2""")
def trend(spark, sf):
    return S.trend(monthly_panel(spark, sf), KEYS, with_p=False)


@query("ts_03_trend_significance")
def trend_p(spark, sf):
    return S.trend(monthly_panel(spark, sf), KEYS)


@query("ts_04_stl_seasonality")
def stl(spark, sf):
    return seasonal.stl_strength(monthly_panel(spark, sf).drop("segment"), KEYS)


@query("ts_05_seasonal_effects", doubles="effect strength", sql=POS + """,
d AS (SELECT *, value - avg(value) OVER (PARTITION BY metric, region ORDER BY date ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS d
  FROM p WHERE n >= 24),
s AS (SELECT *, var_pop(d) OVER (PARTITION BY metric, region) / nullif(var_pop(value) OVER (PARTITION BY metric, region), 0)
  AS strength FROM d)
SELECT metric, region, CAST(month(date) AS INT) AS season, avg(d) AS effect, max(strength) AS strength,
  max(strength) > 0.3 AS detected FROM s GROUP BY 1, 2, 3""")
def seasonal_effects(spark, sf):
    return S.seasonal_effects(monthly_panel(spark, sf), KEYS)


def stepped(spark, sf):
    """The panel with a level shift of a half from 1998 on, so that there is a break to find."""
    lift = F.when(F.year("date") >= 1998, 1.5).otherwise(1.0)
    return monthly_panel(spark, sf).withColumn("value", F.col("value") * lift)


def _break_rounds() -> str:
    """Three unrolled rounds of the segmentation, as SQL."""
    lifted = "value * CASE WHEN year(date) >= 1998 THEN 1.5 ELSE 1.0 END AS value, row_number()"
    sql = POS.replace("value, row_number()", lifted) + """, r0 AS (SELECT metric, region, date, value, pos, 0 AS seg, true AS open, NULL::INT AS ord
  FROM p WHERE n >= 9)"""
    for k in (1, 2, 3):
        sql += f""",
a{k} AS (SELECT *, pos - seg AS i, count(*) OVER s AS len, sum(value) OVER s AS total, var_pop(value) OVER s * count(*) OVER s AS ss,
  coalesce(sum(value) OVER (PARTITION BY metric, region, seg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lsum
  FROM r{k - 1} WINDOW s AS (PARTITION BY metric, region, seg)),
g{k} AS (SELECT *, CASE WHEN open AND i >= 4 AND i < len - 4 THEN
  i * (len - i) / len * pow(lsum / nullif(i, 0) - (total - lsum) / (len - i), 2) END AS gain FROM a{k}),
b{k} AS (SELECT metric, region, arg_max(pos, (gain, -pos)) AS cut, arg_max(seg, (gain, -pos)) AS bseg, max(gain) AS bg,
  arg_max(ss, (gain, -pos)) AS bss FROM g{k} WHERE gain > 0 GROUP BY 1, 2),
r{k} AS (SELECT x.metric, x.region, x.date, x.value, x.pos,
  CASE WHEN bss > 0 AND bg >= 0.25 * bss AND seg = bseg AND pos >= cut THEN cut ELSE seg END AS seg,
  open AND coalesce(bss > 0 AND bg >= 0.25 * bss, false) AS open,
  CASE WHEN bss > 0 AND bg >= 0.25 * bss AND pos = cut THEN {k} ELSE ord END AS ord
  FROM r{k - 1} x LEFT JOIN b{k} USING (metric, region))"""
    return sql + """,
m AS (SELECT *, avg(value) OVER (PARTITION BY metric, region ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS before_mean,
  avg(value) OVER (PARTITION BY metric, region ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS after_mean FROM r3),
breaks AS (SELECT metric, region, date, before_mean, after_mean, (after_mean / before_mean - 1) * 100 AS shift_pct,
  CASE WHEN after_mean > before_mean THEN 'step up' ELSE 'step down' END AS direction FROM m
  WHERE ord IS NOT NULL AND abs((after_mean / before_mean - 1) * 100) >= 3)"""


BREAKS = _break_rounds()


@query("ts_06_breakpoints", doubles="before_mean after_mean shift_pct", sql=BREAKS + " SELECT * FROM breaks")
def breakpoints(spark, sf):
    return S.breakpoints(stepped(spark, sf), KEYS)


@query("rpt_02_break_table", doubles="before_mean after_mean shift_pct", sql=BREAKS + """
SELECT metric, region, date, before_mean, after_mean, shift_pct, direction,
  row_number() OVER (PARTITION BY metric, region ORDER BY date) AS no FROM breaks""")
def break_table(spark, sf):
    from plinth.operators.report import break_rows
    return break_rows(S.breakpoints(stepped(spark, sf), KEYS), KEYS)


@query("jn_10_break_event_interval_join", sql=BREAKS + """,
events_ AS (SELECT DISTINCT CAST(date_trunc('year', o_orderdate) AS DATE) AS ed, 'policy ' || year(o_orderdate) AS title
  FROM orders WHERE year(o_orderdate) % 2 = 0)
SELECT metric, region, date, arg_min(ed, (ed, title)) AS event_date, arg_min(title, (ed, title)) AS title, count(*) AS candidates
FROM breaks JOIN events_ ON ed BETWEEN date - 279 AND date + 279 GROUP BY 1, 2, 3""")
def break_events(spark, sf):
    from plinth.operators.asof import within_months
    year = F.trunc(F.to_date("o_orderdate"), "year")
    events = table(spark, sf, "orders").where(F.year("o_orderdate") % 2 == 0).select(
        year.alias("ed"), F.concat(F.lit("policy "), F.year("o_orderdate").cast("string")).alias("title")).distinct()
    found = S.breakpoints(stepped(spark, sf), KEYS).select(*KEYS, "date")
    return within_months(found, events, KEYS, "date", "ed")


@query("ts_07_turning_points", doubles="value", sql=POS + f""",
s AS (SELECT *, avg(value) OVER ({PART} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS s FROM p WHERE n >= 13),
m AS (SELECT *, max(s) OVER l AS lmax, min(s) OVER l AS lmin, max(s) OVER r AS rmax, min(s) OVER r AS rmin FROM s
  WINDOW l AS ({PART} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), r AS ({PART} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)),
k AS (SELECT *, CASE WHEN s >= lmax AND s >= rmax THEN 'peak' WHEN s <= lmin AND s <= rmin THEN 'trough' END AS kind FROM m
  WHERE pos >= 6 AND pos < n - 6),
b AS (SELECT *, lag(kind) OVER ({PART}) AS b FROM k WHERE kind IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY metric, region ORDER BY date DESC) AS r FROM b WHERE b IS NULL OR b <> kind)
SELECT metric, region, date, kind, value FROM f WHERE r <= 8""")
def turning(spark, sf):
    return S.turning_points(monthly_panel(spark, sf), KEYS)


@query("ts_08_year_on_year", doubles="yoy_pct", sql=POS + f"""
SELECT * FROM (SELECT metric, region, date, (value / lag(value, 12) OVER ({PART}) - 1) * 100 AS yoy_pct FROM p WHERE n > 12)
WHERE yoy_pct IS NOT NULL""")
def yoy(spark, sf):
    return S.year_on_year(monthly_panel(spark, sf), KEYS)


@query("ts_09_holt_winters")
def holt_winters(spark, sf):
    return seasonal.exponential_projection(monthly_panel(spark, sf).drop("segment"), KEYS, 6)


@query("ts_10_line_projection", doubles="forecast lower upper", sql=POS + f""",
d AS (SELECT *, value - lag(value) OVER ({PART}) AS diff FROM p WHERE n >= 6),
f AS (SELECT metric, region, count(*) AS n, max(date) AS e, regr_slope(value, pos) AS b, regr_intercept(value, pos) AS a,
  stddev_pop(diff) AS sd FROM d GROUP BY 1, 2)
SELECT metric, region, CAST(k AS INT) AS step, CAST(e + to_months(CAST(k AS INT)) AS DATE) AS date, a + b * (n + k - 1) AS forecast,
  a + b * (n + k - 1) - 1.96 * sd * sqrt(k) AS lower, a + b * (n + k - 1) + 1.96 * sd * sqrt(k) AS upper
FROM f, (SELECT unnest(range(1, 7)) AS k)""")
def projection(spark, sf):
    return S.line_projection(monthly_panel(spark, sf), KEYS, 6)


@query("agg_19_month_deviation", doubles="deviation_pct", sql="WITH " + PANEL + """,
d AS (SELECT metric, region, date, (value / avg(value) OVER (PARTITION BY metric, region, year(date)) - 1) * 100 AS dev FROM panel)
SELECT metric, region, CAST(month(date) AS INT) AS month, avg(dev) AS deviation_pct FROM d GROUP BY 1, 2, 3""")
def month_deviation(spark, sf):
    return S.month_deviation(monthly_panel(spark, sf), KEYS)


@query("eco_01_real_terms", doubles="nominal real", sql="WITH " + NATIONAL + """,
infl AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_tax) * 10 AS infl FROM lineitem GROUP BY 1),
j AS (SELECT date, value AS nominal, infl FROM series JOIN infl USING (date) WHERE metric = 'price'),
f AS (SELECT *, exp(sum(ln(1 + infl / 100)) OVER (ORDER BY date)) AS lvl FROM j)
SELECT date, nominal, nominal / (lvl / first_value(lvl) OVER (ORDER BY date)) AS real FROM f""")
def real_terms(spark, sf):
    infl = table(spark, sf, "lineitem").groupBy(F.trunc(F.to_date("l_shipdate"), "month").alias("date")) \
        .agg((F.avg("l_tax") * 10).alias("value"))
    return S.real_terms(national_panel(spark, sf).where("metric = 'price'"), infl)


@query("eco_01_real_terms_by_region", doubles="nominal real", sql="WITH " + PANEL + """,
j AS (SELECT a.region, a.date, a.value AS nominal, b.value AS infl FROM panel a JOIN panel b USING (region, date)
  WHERE a.metric = 'price' AND b.metric = 'income'),
f AS (SELECT *, first_value(infl) OVER (PARTITION BY region ORDER BY date) AS base FROM j)
SELECT region, date, nominal, nominal / (infl / base) AS real FROM f""")
def real_terms_by_region(spark, sf):
    rows = monthly_panel(spark, sf)
    return S.real_terms(rows.where("metric = 'price'"), rows.where("metric = 'income'"), ["region"])


AFFORD = "WITH " + PANEL + """
SELECT a.region, a.date, a.value AS price, b.value AS income, a.value / (b.value * 12) AS affordability_years
FROM panel a JOIN panel b USING (region, date) WHERE a.metric = 'price' AND b.metric = 'income'"""


@query("eco_02_affordability", doubles="price income affordability_years", sql=AFFORD)
def affordability(spark, sf):
    rows = monthly_panel(spark, sf)
    return S.affordability(rows.where("metric = 'price'"), rows.where("metric = 'income'"), ["region"])


@query("jn_02_inner_join_dates", doubles="price income", sql=AFFORD.replace(
    ", a.value / (b.value * 12) AS affordability_years", ""))
def inner_dates(spark, sf):
    rows = monthly_panel(spark, sf)
    return S.affordability(rows.where("metric = 'price'"), rows.where("metric = 'income'"), ["region"]) \
        .drop("affordability_years")


@query("jn_14_common_support", doubles="value", sql="WITH " + PANEL + """,
a AS (SELECT date, avg(value) AS value FROM panel WHERE metric = 'price' AND date >= DATE '1996-03-01' GROUP BY 1),
b AS (SELECT date, avg(value) AS value FROM panel WHERE metric = 'income' AND date <= DATE '1999-06-01' GROUP BY 1)
SELECT 'a' AS series, date, value FROM a WHERE date BETWEEN (SELECT min(date) FROM a) AND (SELECT max(date) FROM b)
UNION ALL SELECT 'b', date, value FROM b WHERE date BETWEEN (SELECT min(date) FROM a) AND (SELECT max(date) FROM b)""")
def support(spark, sf):
    rows = monthly_panel(spark, sf).groupBy("metric", "date").agg(F.avg("value").alias("value"))
    return S.common_support(rows.where("metric = 'price' AND date >= '1996-03-01'").drop("metric"),
                            rows.where("metric = 'income' AND date <= '1999-06-01'").drop("metric"))


@query("rpt_01_indicator_dashboard", doubles="latest yoy total_change_pct cagr_pct peak pct_from_peak", sql=SUMMARY + """
SELECT metric, region, latest, "end" AS as_at, yoy_pct AS yoy, '%' AS yoy_unit, total_change_pct, cagr_pct, maximum AS peak,
  pct_from_peak, direction FROM summary""")
def dashboard(spark, sf):
    from plinth.operators.report import dashboard_rows
    return dashboard_rows(S.summary(monthly_panel(spark, sf), KEYS), KEYS)


@query("rul_01_rule_flags", sql=SUMMARY + """
SELECT metric, region, 'growth' AS code FROM summary WHERE cagr_pct > 12
UNION ALL SELECT metric, region, 'falling' FROM summary WHERE yoy_pct < 0 AND NOT coalesce(cagr_pct > 12, false)
UNION ALL SELECT metric, region, 'risk_growth' FROM summary WHERE cagr_pct > 15
UNION ALL SELECT metric, region, 'risk_volatility' FROM summary WHERE volatility_pct > 25""")
def rules(spark, sf):
    from plinth.operators.report import series_rules
    return series_rules(S.summary(monthly_panel(spark, sf), KEYS), KEYS)


@query("rul_02_price_income_gap", doubles="price_cagr income_cagr gap", sql=SUMMARY + """
SELECT region, p.cagr_pct AS price_cagr, i.cagr_pct AS income_cagr, p.cagr_pct - i.cagr_pct AS gap
FROM (SELECT * FROM summary WHERE metric = 'price') p JOIN (SELECT * FROM summary WHERE metric = 'income') i USING (region)
WHERE p.cagr_pct IS NOT NULL AND i.cagr_pct IS NOT NULL""")
def gap(spark, sf):
    from plinth.operators.report import price_income_gap
    return price_income_gap(S.summary(monthly_panel(spark, sf), KEYS), roles(spark), ["region"])
