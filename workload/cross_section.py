"""Distribution, group, yield and mix tables over the listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import cross_section as X
from workload.registry import query
from workload.tables import LISTINGS, listings, table

WITH = "WITH " + LISTINGS


@query("agg_01_overall", doubles="mean minimum maximum mean_per_sqm median p25 p75 p90 median_per_sqm median_area "
       "median_rooms skew_mean_over_median_pct", sql=WITH + """
SELECT count(price_usd) AS listings, avg(price_usd) AS mean, min(price_usd) AS minimum, max(price_usd) AS maximum,
  avg(sqm_usd) AS mean_per_sqm, min(date) AS posted_from, max(date) AS posted_to,
  quantile_cont(price_usd, 0.5) AS median, quantile_cont(price_usd, 0.25) AS p25, quantile_cont(price_usd, 0.75) AS p75,
  quantile_cont(price_usd, 0.9) AS p90, quantile_cont(sqm_usd, 0.5) AS median_per_sqm,
  quantile_cont(total_area, 0.5) AS median_area, quantile_cont(rooms, 0.5) AS median_rooms,
  (avg(price_usd) / quantile_cont(price_usd, 0.5) - 1) * 100 AS skew_mean_over_median_pct
FROM listings HAVING count(price_usd) >= 20""")
def overall(spark, sf):
    return X.overall(listings(spark, sf))


GROUP_STATS = WITH + """,
nat AS (SELECT quantile_cont(price_usd, 0.5) AS national FROM listings),
g AS (SELECT region, count(*) AS listings, avg(price_usd) AS mean, quantile_cont(price_usd, 0.5) AS median,
  quantile_cont(price_usd, 0.25) AS p25, quantile_cont(price_usd, 0.75) AS p75,
  quantile_cont(sqm_usd, 0.5) AS median_per_sqm, quantile_cont(total_area, 0.5) AS median_area_sqm
  FROM listings GROUP BY region),
stats AS (SELECT region, listings, median, mean, p25, p75, median_per_sqm, median_area_sqm,
  listings * 100.0 / sum(listings) OVER () AS share_of_listings_pct,
  (median / national - 1) * 100 AS vs_national_pct,
  CASE WHEN listings >= 30 THEN 'adequate' ELSE 'thin — indicative only' END AS sample FROM g, nat)"""


@query("agg_02_group_stats", doubles="median mean p25 p75 median_per_sqm median_area_sqm share_of_listings_pct "
       "vs_national_pct", sql=GROUP_STATS + " SELECT * FROM stats")
def group_stats(spark, sf):
    return X.group_stats(listings(spark, sf), "region")


@query("agg_02_ranking", doubles="top_median low_median spread_ratio dispersion_pct", sql=GROUP_STATS + """,
ranked AS (SELECT * FROM stats WHERE listings >= 30 OR NOT (SELECT bool_or(listings >= 30) FROM stats))
SELECT count(*) FILTER (WHERE listings >= 30) AS reliable_groups, arg_max(region, (median, region)) AS most_expensive,
  max(median) AS top_median, arg_min(region, (median, region)) AS cheapest, min(median) AS low_median,
  max(median) / min(median) AS spread_ratio, stddev_pop(median) / avg(median) * 100 AS dispersion_pct FROM ranked""")
def ranking(spark, sf):
    return X.ranking(X.group_stats(listings(spark, sf), "region"), "region")


@query("agg_03_room_bands", doubles="mean median median_per_sqm median_area_sqm", sql=WITH + """
SELECT CASE CAST(rooms AS INT) WHEN 1 THEN '1 room' WHEN 2 THEN '2 rooms' WHEN 3 THEN '3 rooms'
  WHEN 4 THEN '4 rooms' ELSE '5+ rooms' END AS size_band, count(*) AS listings, avg(price_usd) AS mean,
  quantile_cont(price_usd, 0.5) AS median, quantile_cont(sqm_usd, 0.5) AS median_per_sqm,
  quantile_cont(total_area, 0.5) AS median_area_sqm, CAST(least(CAST(rooms AS INT), 5) AS BIGINT) AS ord
FROM listings GROUP BY 1, 7""")
def by_rooms(spark, sf):
    return X.by_rooms(listings(spark, sf))


@query("agg_04_category_medians", doubles="median median_per_sqm", sql="""
WITH parts AS (SELECT p_type AS condition, p_retailprice AS price_usd, p_retailprice / p_size AS sqm_usd FROM part),
g AS (SELECT condition, count(*) AS listings, quantile_cont(price_usd, 0.5) AS median,
  quantile_cont(sqm_usd, 0.5) AS median_per_sqm FROM parts GROUP BY 1 HAVING count(*) >= 25)
SELECT * FROM g WHERE (SELECT count(*) FROM g) >= 2 ORDER BY median DESC, condition LIMIT 10""")
def by_category(spark, sf):
    parts = table(spark, sf, "part").select(
        F.col("p_type").alias("condition"), F.col("p_retailprice").alias("price_usd"),
        (F.col("p_retailprice") / F.col("p_size")).alias("sqm_usd"))
    return X.by_category(parts, "condition")


@query("agg_10_regional_medians", doubles="median", sql=WITH + """
SELECT region, property, count(*) AS listings,
  CASE WHEN count(*) >= 15 THEN quantile_cont(sqm_usd, 0.5) / 1000 END AS median
FROM listings WHERE kind = 'rent' AND market = 'F' GROUP BY 1, 2""")
def regional_medians(spark, sf):
    rows = listings(spark, sf).where("kind = 'rent' AND market = 'F'")
    return X.table_medians(rows, ["region", "property"], "sqm_usd", unit=1000)


YIELDS = WITH + """,
sides AS (SELECT region, property, rooms, kind, count(*) AS n, quantile_cont(sqm_usd, 0.5) AS median
  FROM listings GROUP BY 1, 2, 3, 4 HAVING count(*) >= 15),
yields AS (SELECT region, property, rooms, r.n AS rent_n, s.n AS sale_n, r.median AS rent_median,
  s.median AS sale_median, 1200 * r.median / s.median AS yield_pct
  FROM (SELECT * FROM sides WHERE kind = 'rent') r JOIN (SELECT * FROM sides WHERE kind = 'sale') s
  USING (region, property, rooms))"""


@query("agg_11_rental_yield", doubles="rent_median sale_median yield_pct", sql=YIELDS + " SELECT * FROM yields")
def rental_yield(spark, sf):
    return X.rental_yield(listings(spark, sf), ["region", "property", "rooms"])


@query("jn_06_strata_self_join", doubles="rent_median sale_median", sql=YIELDS + """
SELECT region, property, rooms, rent_n, sale_n, rent_median, sale_median FROM yields""")
def strata_join(spark, sf):
    return X.rental_yield(listings(spark, sf), ["region", "property", "rooms"]).drop("yield_pct")


@query("idx_13_yield_summary", doubles="low high middle payback_years", sql=YIELDS + """
SELECT count(yield_pct) AS strata, min(yield_pct) AS low, max(yield_pct) AS high,
  quantile_cont(yield_pct, 0.5) AS middle, 100 / quantile_cont(yield_pct, 0.5) AS payback_years FROM yields""")
def yield_summary(spark, sf):
    return X.yield_summary(X.rental_yield(listings(spark, sf), ["region", "property", "rooms"]))


@query("agg_12_source_mix", doubles="share_pct", sql=WITH + """
SELECT source, kind, property, count(*) AS listings, count(*) * 100.0 / sum(count(*)) OVER () AS share_pct
FROM listings GROUP BY 1, 2, 3""")
def source_mix(spark, sf):
    return X.source_mix(listings(spark, sf))


@query("agg_13_contribution", doubles="latest first share_pct change_pct contribution_pct", digits=3, sql=WITH + """,
t AS (SELECT region, date_trunc('quarter', date) AS q, sum(price_usd) AS v FROM listings GROUP BY 1, 2),
e AS (SELECT min(q) AS a, max(q) AS b FROM t),
g AS (SELECT region, max(CASE WHEN q = b THEN v END) AS latest, max(CASE WHEN q = a THEN v END) AS first
  FROM t, e WHERE q IN (a, b) GROUP BY 1),
s AS (SELECT *, sum(latest) OVER () AS lt, sum(first) OVER () AS ft FROM g)
SELECT region, latest, first, latest / lt * 100 AS share_pct, (latest / first - 1) * 100 AS change_pct,
  (latest - first) / (lt - ft) * 100 AS contribution_pct FROM s WHERE latest IS NOT NULL""")
def contribution(spark, sf):
    rows = listings(spark, sf).withColumn("q", F.trunc("date", "quarter"))
    return X.contribution(rows, "region", "price_usd", "q")


@query("agg_14_concentration", doubles="hhi top_share_pct top3_share_pct", sql=WITH + """,
t AS (SELECT region, date_trunc('quarter', date) AS q, sum(price_usd) AS v FROM listings GROUP BY 1, 2),
s AS (SELECT region, v / sum(v) OVER () AS s FROM t WHERE q = (SELECT max(q) FROM t)),
r AS (SELECT *, row_number() OVER (ORDER BY s DESC, region) AS r FROM s)
SELECT count(*) AS groups, sum(s * s) * 10000 AS hhi, min(CASE WHEN r = 1 THEN region END) AS top_group,
  max(s) * 100 AS top_share_pct, sum(CASE WHEN r <= 3 THEN s END) * 100 AS top3_share_pct FROM r""")
def concentration(spark, sf):
    rows = listings(spark, sf).withColumn("q", F.trunc("date", "quarter"))
    return X.concentration(rows, "region", "price_usd", "q")


@query("agg_17_segment_bars", doubles="value", sql=WITH + """,
m AS (SELECT region, avg(price_usd) AS v FROM listings
  WHERE date_trunc('quarter', date) = (SELECT max(date_trunc('quarter', date)) FROM listings) GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY v DESC, region) AS r FROM m)
SELECT CASE WHEN r <= 7 THEN region ELSE 'Other' END AS segment, avg(v) AS value, CAST(min(r) AS INT) AS ord
FROM r GROUP BY 1""")
def segment_bars(spark, sf):
    rows = listings(spark, sf).withColumn("q", F.trunc("date", "quarter"))
    return X.segment_bars(rows, "region", "price_usd", "q")


@query("agg_18_histogram", doubles="from_value to_value", sql=WITH + """,
e AS (SELECT quantile_cont(price_usd, 0.98) AS hi, min(price_usd) AS lo, count(*) AS n FROM listings),
b AS (SELECT CASE WHEN price_usd <= hi THEN least(CAST(floor((price_usd - lo) / ((hi - lo) / 40.0)) AS INT), 39) END AS bin,
  count(*) AS listings FROM listings, e WHERE n >= 50 GROUP BY 1)
SELECT bin, lo + bin * ((hi - lo) / 40.0) AS from_value, lo + (bin + 1) * ((hi - lo) / 40.0) AS to_value, listings,
  coalesce((SELECT listings FROM b WHERE bin IS NULL), 0) AS hidden FROM b, e WHERE bin IS NOT NULL""")
def histogram(spark, sf):
    return X.histogram(listings(spark, sf), "price_usd")


@query("agg_18_quantile_table", doubles="value", sql=WITH + """
SELECT 'p10' AS statistic, quantile_cont(price_usd, 0.1) AS value FROM listings
UNION ALL SELECT 'p25', quantile_cont(price_usd, 0.25) FROM listings
UNION ALL SELECT 'p50', quantile_cont(price_usd, 0.5) FROM listings
UNION ALL SELECT 'p75', quantile_cont(price_usd, 0.75) FROM listings
UNION ALL SELECT 'p90', quantile_cont(price_usd, 0.9) FROM listings""")
def quantile_table(spark, sf):
    return X.quantile_table(listings(spark, sf), "price_usd")


@query("agg_22_unclassified_share", doubles="share_pct", sql=WITH + """
SELECT count(*) AS listings, count(*) FILTER (WHERE market = 'P' OR market IS NULL) AS unclassified,
  count(*) FILTER (WHERE market = 'P' OR market IS NULL) * 100.0 / count(*) AS share_pct FROM listings""")
def unknown_share(spark, sf):
    return X.unknown_share(listings(spark, sf), "market", "P")


@query("win_16_share_of_total", doubles="share_pct", sql=WITH + """
SELECT region, property, count(*) AS listings,
  count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY property) AS share_pct FROM listings GROUP BY 1, 2""")
def share_of_total(spark, sf):
    from plinth.operators.windows import share_within
    counts = listings(spark, sf).groupBy("region", "property").agg(F.count("*").alias("listings"))
    return share_within(counts, "listings", ["property"])


@query("qa_09_caveat_flags", sql=GROUP_STATS + """
SELECT coalesce(arg_max(share_of_listings_pct, (median, region)) > 60, false) AS concentrated,
  count(*) FILTER (WHERE listings < 30) AS thin_groups, count(*) AS groups, true AS standing_supply FROM stats""")
def caveats(spark, sf):
    return X.caveats(X.group_stats(listings(spark, sf), "region"))


@query("rpt_03_overall_table", doubles="value", sql=WITH + """
SELECT 'median' AS statistic, quantile_cont(price_usd, 0.5) AS value FROM listings
UNION ALL SELECT 'mean', avg(price_usd) FROM listings
UNION ALL SELECT 'p25', quantile_cont(price_usd, 0.25) FROM listings
UNION ALL SELECT 'p75', quantile_cont(price_usd, 0.75) FROM listings
UNION ALL SELECT 'minimum', min(price_usd) FROM listings UNION ALL SELECT 'maximum', max(price_usd) FROM listings
UNION ALL SELECT 'listings', CAST(count(*) AS DOUBLE) FROM listings""")
def overall_table(spark, sf):
    from plinth.operators.report import overall_rows
    return overall_rows(X.overall(listings(spark, sf)))


@query("rpt_03_region_table", doubles="median vs_national_pct share_of_listings_pct", sql=GROUP_STATS + """
SELECT region, listings, median, vs_national_pct, share_of_listings_pct, sample FROM stats""")
def region_table(spark, sf):
    from plinth.operators.report import region_rows
    return region_rows(X.group_stats(listings(spark, sf), "region"), "region")
