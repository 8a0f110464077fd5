"""Archive aggregates, the index family, as-of rates, regional comparison and drivers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinth.operators import archive as A
from plinth.operators import asof, drivers as D
from plinth.operators import index as I
from plinth.operators import regional as R
from plinth.session import measured
from workload.registry import ORACLES, query
from workload.series_queries import NEAR, RANKED, roles, ROLES_SQL  # noqa: F401
from workload.tables import (FX, LISTINGS, NATIONAL, PANEL, QUARTERLY, fx_rates, listings, monthly_panel,
                             national_panel, quarterly, table)

WITH = "WITH " + LISTINGS
THIN = 15


def archive_rows(spark, sf):
    return listings(spark, sf).where("kind = 'sale'").select(
        F.trunc("date", "month").alias("month"), F.col("region").alias("region_uz"), "market",
        F.when(F.col("macro_region") == "ASIA", F.col("region")).otherwise("Ko'rsatilmagan").alias("district"),
        F.col("price_usd").alias("price"), F.col("sqm_usd").alias("usd_sqm"))


AGG5 = """SELECT '{name}' AS name, CAST(date_trunc('{period}', date) AS DATE) AS period, region AS place, market, count(*) AS listings,
  count(DISTINCT date_trunc('month', date)) AS months, quantile_cont(sqm_usd, 0.5) AS median_usd_sqm,
  quantile_cont(price_usd, 0.5) AS median_usd FROM listings WHERE kind = 'sale' {more} GROUP BY 2, 3, 4"""


@query("agg_05_archive_groupings", doubles="median_usd_sqm median_usd", sql=WITH + " " + " UNION ALL ".join([
    AGG5.format(name="monthly", period="month", more=""), AGG5.format(name="quarterly", period="quarter", more=""),
    AGG5.format(name="quarterly_district", period="quarter", more="AND macro_region = 'ASIA'")]))
def groupings(spark, sf):
    out = None
    for name, df in A.published_tables(archive_rows(spark, sf)).items():
        keys = A.TABLE_KEYS[name]
        part = df.select(F.lit(name).alias("name"), F.col(keys[0]).alias("period"), F.col(keys[1]).alias("place"), "market",
                         "listings", "months", "median_usd_sqm", "median_usd")
        out = part if out is None else out.unionByName(part)
    return out


@query("agg_06_larger_sample_wins", doubles="median_usd_sqm", sql=WITH + """,
parts AS (SELECT source, CAST(date_trunc('quarter', date) AS DATE) AS quarter, region AS region_uz, market, count(*) AS listings,
  quantile_cont(sqm_usd, 0.5) AS median_usd_sqm FROM listings WHERE kind = 'sale' GROUP BY 1, 2, 3, 4)
SELECT quarter, region_uz, market, listings, median_usd_sqm, source FROM parts
QUALIFY row_number() OVER (PARTITION BY quarter, region_uz, market ORDER BY listings DESC, source) = 1""")
def larger_sample(spark, sf):
    from plinth.operators.order_stats import summarise
    rows = listings(spark, sf).where("kind = 'sale'").withColumn("quarter", F.trunc("date", "quarter"))
    parts = summarise(rows, ["source", "quarter", "region", "market"], [F.count("*").alias("listings")],
                      {"sqm_usd": {"median_usd_sqm": .5}}).withColumnRenamed("region", "region_uz")
    return A.combine_parts(parts.select("source", "quarter", "region_uz", "market", "listings", "median_usd_sqm"),
                           ["quarter", "region_uz", "market"])


LIVE = """SELECT DATE '2001-08-01' AS month, region AS region_uz, market, count(*) AS listings,
  quantile_cont(sqm_usd, 0.5) AS median_usd_sqm, quantile_cont(price_usd, 0.5) AS median_usd
FROM listings WHERE kind = 'sale' AND property = 'F' GROUP BY 2, 3"""


@query("agg_07_live_month", doubles="median_usd_sqm median_usd", sql=WITH + " " + LIVE)
def live(spark, sf):
    return A.live_month(listings(spark, sf), "2001-08-15", prop="F", region="region")


MONTHLY = """monthly AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, region AS region_uz, market, count(*) AS listings,
  quantile_cont(sqm_usd, 0.5) AS median_usd_sqm, quantile_cont(price_usd, 0.5) AS median_usd
  FROM listings WHERE kind = 'sale' GROUP BY 1, 2, 3)"""


def monthly(spark, sf):
    return measured(A.aggregate_archive(archive_rows(spark, sf), ["month", "region_uz", "market"]))


@query("set_05_replace_month", doubles="median_usd_sqm median_usd", sql=WITH + "," + MONTHLY + ", live AS (" + LIVE + """)
SELECT * FROM monthly WHERE month NOT IN (SELECT month FROM live) UNION ALL SELECT * FROM live""")
def replace_month(spark, sf):
    from plinth.operators.sets import replace_partition
    now = A.live_month(listings(spark, sf), "2001-08-15", prop="F", region="region")
    return replace_partition(monthly(spark, sf).drop("months"), now, ["month"])


@query("agg_08_national_level", doubles="median_usd_sqm", sql=WITH + "," + MONTHLY + """
SELECT month, sum(listings) AS listings, sum(median_usd_sqm * listings) / sum(listings) AS median_usd_sqm FROM monthly GROUP BY 1""")
def national_level(spark, sf):
    return A.national(monthly(spark, sf), "month")


ANNUAL = WITH + "," + MONTHLY + """,
y AS (SELECT CAST(year(month) AS INT) AS year, count(DISTINCT month) AS months, sum(listings) AS listings,
  sum(median_usd_sqm * listings) / sum(listings) AS median FROM monthly GROUP BY 1),
annual AS (SELECT *, (median / lag(median) OVER (ORDER BY year) - 1) * 100 AS change_pct FROM y)"""


@query("agg_09_annual_table", doubles="median change_pct", sql=ANNUAL + " SELECT * FROM annual")
def annual(spark, sf):
    return I.annual_history(monthly(spark, sf))


@query("agg_25_annual_reading", doubles="first_level last_level fastest_pct slowest_pct total_pct annualised_pct", sql=ANNUAL + """,
r AS (SELECT count(*) AS years, min(year) AS first_year, max(year) AS last_year, arg_min(median, year) AS first_level,
  arg_max(median, year) AS last_level, arg_max(year, change_pct) AS fastest_year, max(change_pct) AS fastest_pct,
  arg_min(year, change_pct) AS slowest_year, min(change_pct) AS slowest_pct FROM annual)
SELECT *, (last_level / first_level - 1) * 100 AS total_pct,
  (pow(last_level / first_level, 1.0 / (last_year - first_year)) - 1) * 100 AS annualised_pct FROM r""")
def annual_reading(spark, sf):
    return I.annual_reading(I.annual_history(monthly(spark, sf)))


@query("idx_12_across_gap", doubles="before_level latest_level change_pct", sql=WITH + "," + MONTHLY + """,
n AS (SELECT month, sum(listings) AS listings, sum(median_usd_sqm * listings) / sum(listings) AS lvl FROM monthly
  WHERE month NOT BETWEEN DATE '1998-03-01' AND DATE '1998-06-01' GROUP BY 1),
p AS (SELECT *, lag(month) OVER (ORDER BY month) AS prev FROM n),
g AS (SELECT arg_max(prev, month) AS b FROM p WHERE prev IS NOT NULL AND month > prev + INTERVAL 1 MONTH)
SELECT max(month) FILTER (WHERE month = b) AS before_month, max(lvl) FILTER (WHERE month = b) AS before_level,
  max(listings) FILTER (WHERE month = b) AS before_listings, arg_max(month, month) AS latest_month,
  arg_max(lvl, month) AS latest_level, arg_max(listings, month) AS latest_listings,
  (arg_max(lvl, month) / max(lvl) FILTER (WHERE month = b) - 1) * 100 AS change_pct,
  arg_max(listings, month) < max(listings) FILTER (WHERE month = b) / 10.0 AS tiny_sample FROM n, g""")
def across_gap(spark, sf):
    return I.across_gap(monthly(spark, sf).where("month NOT BETWEEN '1998-03-01' AND '1998-06-01'"))


@query("rpt_12_history_with_gaps", doubles="median_usd_sqm", sql=WITH + "," + MONTHLY + """,
n AS (SELECT month, sum(listings) AS listings, sum(median_usd_sqm * listings) / sum(listings) AS median_usd_sqm FROM monthly
  WHERE month NOT BETWEEN DATE '1998-03-01' AND DATE '1998-06-01' GROUP BY 1)
SELECT * FROM (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM n)
LEFT JOIN n USING (month)""")
def history_gaps(spark, sf):
    return I.history_with_gaps(monthly(spark, sf).where("month NOT BETWEEN '1998-03-01' AND '1998-06-01'"))


# ---- index ------------------------------------------------------------------

W_SQL = "WITH " + QUARTERLY + """,
c AS (SELECT region_uz, market, sum(listings) AS n FROM quarterly GROUP BY 1, 2
  HAVING count(DISTINCT quarter) = (SELECT count(DISTINCT quarter) FROM quarterly)),
weights AS (SELECT region_uz, market, n / sum(n) OVER () AS weight FROM c)"""
LEVELS = W_SQL + """,
lv AS (SELECT quarter, sum(listings) AS listings, sum(weight * median_usd_sqm) / sum(weight) AS median_usd_sqm,
  sum(listings) FILTER (WHERE weight IS NOT NULL) * 100.0 / sum(listings) AS coverage, count(weight) AS strata,
  'fixed' AS weighting, max(months) AS months FROM quarterly LEFT JOIN weights USING (region_uz, market) GROUP BY 1),
levels AS (SELECT *, median_usd_sqm / first_value(median_usd_sqm) OVER (ORDER BY quarter) * 100 AS index FROM lv)"""
RATES = """rates AS (SELECT quarter, 12000 + 50 * (year(quarter) - 1995) + 10 * quarter(quarter) AS rate FROM
  (SELECT DISTINCT quarter FROM quarterly))"""


def balanced(spark, sf):
    """The archive quarters; markets F and O are missing in parts of the calendar, so strata pool markets."""
    return measured(quarterly(spark, sf))


def pooled(spark, sf):
    """Quarter x region with one market, present in every quarter: a non-trivial fixed basket."""
    from plinth.operators.archive import aggregate_archive
    rows = archive_rows(spark, sf).withColumn("market", F.lit("all"))
    return measured(aggregate_archive(rows, ["quarter", "region_uz", "market"]))


POOLED = QUARTERLY.replace("region AS region_uz, market,", "region AS region_uz, 'all' AS market,")
W_POOL = W_SQL.replace(QUARTERLY, POOLED)
LEVELS = LEVELS.replace(QUARTERLY, POOLED)


def rates(q):
    return q.select("quarter").distinct().withColumn(
        "rate", (12000 + 50 * (F.year("quarter") - 1995) + 10 * F.quarter("quarter")).cast("double"))


@query("idx_01_fixed_weights", doubles="weight", digits=7, sql=W_POOL + " SELECT region_uz, market, weight FROM weights")
def fixed_weights(spark, sf):
    return I.fixed_weights(pooled(spark, sf))


@query("idx_02_fixed_weight_index", doubles="median_usd_sqm coverage index", sql=LEVELS + " SELECT * FROM levels")
def index_series(spark, sf):
    return I.index_series(pooled(spark, sf))


@query("idx_02_volume_fallback_index", doubles="median_usd_sqm coverage index", sql="WITH " + QUARTERLY + """,
c AS (SELECT region_uz, market FROM quarterly GROUP BY 1, 2
  HAVING count(DISTINCT quarter) = (SELECT count(DISTINCT quarter) FROM quarterly)),
lv AS (SELECT quarter, sum(listings) AS listings, sum(median_usd_sqm * listings) / sum(listings) AS median_usd_sqm,
  100.0 AS coverage, 0 AS strata, 'volume' AS weighting, max(months) AS months FROM quarterly
  WHERE (SELECT count(*) FROM c) >= 0 AND market <> 'P' GROUP BY 1)
SELECT *, median_usd_sqm / first_value(median_usd_sqm) OVER (ORDER BY quarter) * 100 AS index FROM lv""")
def index_fallback(spark, sf):
    q = balanced(spark, sf).where("market <> 'P'")
    late = q.withColumn("region_uz", F.concat("region_uz", F.lit("/"), F.year("quarter").cast("string")))
    return I.index_series(late)


@query("rpt_07_index_table", doubles="level coverage index change_pct", sql=LEVELS + """
SELECT year(quarter) || '-Ch' || quarter(quarter) AS label, quarter, months, median_usd_sqm AS level, coverage, listings, index,
  (index / lag(index) OVER (ORDER BY quarter) - 1) * 100 AS change_pct FROM levels""")
def index_table(spark, sf):
    return I.index_table(I.index_series(pooled(spark, sf)))


COMPARE = "WITH " + QUARTERLY + "," + RATES + """,
ks AS (SELECT quarter, row_number() OVER (ORDER BY quarter) - 1 AS k FROM
  (SELECT DISTINCT quarter FROM quarterly WHERE market = 'F' ORDER BY quarter DESC LIMIT 3)),
cells AS (SELECT region_uz, k, CASE WHEN listings >= 15 THEN median_usd_sqm * rate / 1e6 END AS v
  FROM quarterly JOIN ks USING (quarter) JOIN rates USING (quarter) WHERE market = 'F'),
w AS (SELECT region_uz, max(v) FILTER (WHERE k = 0) AS v0, max(v) FILTER (WHERE k = 1) AS v1, max(v) FILTER (WHERE k = 2) AS v2
  FROM cells GROUP BY 1),
cmp AS (SELECT region_uz, CAST(NULL AS BIGINT) AS ord, v1 AS level_before, (v1 / v0 - 1) * 100 AS change_before_pct, v2 AS level,
  (v2 / v1 - 1) * 100 AS change_pct, true AS local_currency FROM w)"""


def comparison_of(spark, sf):
    q = balanced(spark, sf).where("market = 'F'")
    return I.comparison(q, "region_uz", I.last_quarters(q), rates(q), minimum=THIN)


@query("idx_03_comparison_table", doubles="level_before change_before_pct level change_pct", sql=COMPARE + " SELECT * FROM cmp")
def comparison(spark, sf):
    return comparison_of(spark, sf)


@query("idx_04_thin_groups", sql="WITH " + QUARTERLY + """
SELECT region_uz, market, listings FROM quarterly WHERE listings < 15 AND quarter = DATE '1998-04-01'""")
def thin(spark, sf):
    return I.thin_groups(balanced(spark, sf), "region_uz", F.lit("1998-04-01").cast("date"), THIN)


CPI = "cpi(year, pct) AS (VALUES (1995, 10.0), (1996, 12.0), (1997, 9.0), (1998, 8.5), (1999, 11.0))"


def cpi(spark):
    return spark.createDataFrame([(1995, 10.0), (1996, 12.0), (1997, 9.0), (1998, 8.5), (1999, 11.0)], "year int, pct double")


PRICE_LEVEL = LEVELS + "," + CPI + """,
yr AS (SELECT y AS year, 1 + coalesce(pct, 11.0) / 100 AS f, pct IS NULL AND y > 1999 AS carried FROM
  (SELECT unnest(range(1995, 2002)) AS y) LEFT JOIN cpi ON y = year),
ys AS (SELECT *, coalesce(exp(sum(ln(f)) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS s FROM yr),
raw AS (SELECT quarter, s * pow(f, quarter(quarter) / 4.0) AS raw, carried FROM levels JOIN ys ON year(quarter) = year),
plevel AS (SELECT quarter, raw / first_value(raw) OVER (ORDER BY quarter) AS level, carried FROM raw)"""


@query("eco_03_price_level", doubles="level", digits=6, sql=PRICE_LEVEL + " SELECT * FROM plevel")
def price_level(spark, sf):
    return I.price_level(cpi(spark), pooled(spark, sf).select("quarter"))


REAL = PRICE_LEVEL + "," + RATES.replace("quarterly)", "levels)") + """,
som AS (SELECT quarter, median_usd_sqm * rate / 1e6 AS som_sqm FROM levels JOIN rates USING (quarter)),
somx AS (SELECT quarter, som_sqm / first_value(som_sqm) OVER (ORDER BY quarter) * 100 AS som_index FROM som),
real AS (SELECT quarter, som_index, level, som_index / level AS real_index, carried FROM somx JOIN plevel USING (quarter))"""


def real(spark, sf):
    q = pooled(spark, sf)
    levels = I.index_series(q, rates=rates(q))
    return I.real_index(I.som_index(levels), I.price_level(cpi(spark), q.select("quarter")))


@query("idx_05_real_index", doubles="som_index level real_index", sql=REAL + " SELECT * FROM real")
def real_index(spark, sf):
    return real(spark, sf)


@query("idx_05_real_growth", doubles="nominal_pct inflation_pct real_pct", sql=REAL + """,
g AS (SELECT arg_max(som_index, quarter) - 100 AS nominal_pct, (arg_max(level, quarter) / arg_min(level, quarter) - 1) * 100 AS inflation_pct,
  (arg_max(real_index, quarter) / 100 - 1) * 100 AS real_pct, count(*) FILTER (WHERE carried) AS carried_quarters FROM real)
SELECT *, CASE WHEN real_pct > 1 THEN 'faster' WHEN real_pct < -1 THEN 'slower' ELSE 'level' END AS verdict FROM g""")
def real_growth(spark, sf):
    return I.real_growth(real(spark, sf))


@query("idx_06_pace", doubles="last_change earlier_mean deepest", sql=LEVELS + """,
s AS (SELECT quarter, (index / lag(index) OVER (ORDER BY quarter) - 1) * 100 AS change FROM levels),
b AS (SELECT *, row_number() OVER (ORDER BY quarter DESC) AS back FROM s WHERE change IS NOT NULL),
a AS (SELECT count(*) AS steps, max(change) FILTER (WHERE back = 1) AS last_change,
  avg(change) FILTER (WHERE back BETWEEN 2 AND 4) AS earlier_mean, count(*) FILTER (WHERE change < 0) AS falls,
  min(change) FILTER (WHERE change < 0) AS deepest FROM b)
SELECT *, CASE WHEN abs(last_change - earlier_mean) < 0.3 THEN 'unchanged' WHEN last_change > earlier_mean THEN 'faster'
  ELSE 'slower' END AS pace FROM a""")
def pace(spark, sf):
    return I.pace(I.index_series(pooled(spark, sf)))


@query("idx_07_currency_effect", doubles="dollar_pct local_pct", sql=LEVELS + "," + RATES.replace("quarterly)", "levels)") + """
SELECT count(*) AS quarters, (arg_max(median_usd_sqm, quarter) / arg_min(median_usd_sqm, quarter) - 1) * 100 AS dollar_pct,
  (arg_max(median_usd_sqm * rate, quarter) / arg_min(median_usd_sqm * rate, quarter) - 1) * 100 AS local_pct
FROM levels JOIN rates USING (quarter)""")
def currency(spark, sf):
    q = pooled(spark, sf)
    return I.currency_effect(I.index_series(q, rates=rates(q)))


@query("idx_07_rate_pass_through", doubles="rate rate_before effect_pct", sql=WITH + """,
q AS (SELECT DISTINCT CAST(date_trunc('quarter', date) AS DATE) AS quarter FROM listings),
r AS (SELECT quarter, 12000.0 + 50 * (year(quarter) - 1995) + 10 * quarter(quarter) AS rate, row_number() OVER (ORDER BY quarter DESC) AS b FROM q),
p AS (SELECT max(rate) FILTER (WHERE b = 1) AS rate, max(rate) FILTER (WHERE b = 2) AS rate_before FROM r)
SELECT *, (rate / rate_before - 1) * 100 AS effect_pct, CASE WHEN abs((rate / rate_before - 1) * 100) < 0.1 THEN 'none'
  WHEN rate < rate_before THEN 'cheaper' ELSE 'dearer' END AS reading FROM p""")
def pass_through(spark, sf):
    q = listings(spark, sf).select(F.trunc("date", "quarter").alias("quarter"))
    return I.rate_pass_through(rates(q))


@query("idx_08_partial_periods", sql="WITH " + QUARTERLY + """,
q AS (SELECT quarter, CAST(max(months) AS INT) AS months FROM quarterly GROUP BY 1)
SELECT 'quarter' AS kind, year(quarter) || '-Ch' || quarter(quarter) AS label, months FROM q WHERE months BETWEEN 1 AND 2
UNION ALL SELECT 'year', CAST(year(quarter) AS VARCHAR), CAST(sum(months) AS INT) FROM q GROUP BY 2 HAVING sum(months) BETWEEN 1 AND 11""")
def partial(spark, sf):
    return I.partial_periods(balanced(spark, sf))


@query("idx_09_level_change_correlation", doubles="rho", sql=COMPARE + """,
r AS (SELECT rank() OVER (ORDER BY level) + (count(*) OVER (PARTITION BY level) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY change_pct) + (count(*) OVER (PARTITION BY change_pct) - 1) / 2.0 AS b FROM cmp
  WHERE level IS NOT NULL AND change_pct IS NOT NULL)
SELECT count(*) AS places, corr(a, b) AS rho, CASE WHEN corr(a, b) <= -0.4 THEN 'converging' WHEN corr(a, b) >= 0.4 THEN 'diverging'
  ELSE 'no pattern' END AS reading FROM r HAVING count(*) >= 6""")
def rank_correlation(spark, sf):
    return I.level_change_rank_correlation(comparison_of(spark, sf))


@query("idx_10_persistence", doubles="up_share pace", sql=COMPARE + """,
a AS (SELECT count(*) AS places, count(*) FILTER (WHERE change_before_pct * change_pct < 0) AS turned,
  count(*) FILTER (WHERE change_before_pct * change_pct > 0) AS held,
  avg(CASE WHEN change_before_pct * change_pct > 0 THEN CAST(change_pct > 0 AS DOUBLE) END) AS up_share,
  avg(abs(change_pct)) FILTER (WHERE change_before_pct * change_pct > 0)
   - avg(abs(change_before_pct)) FILTER (WHERE change_before_pct * change_pct > 0) AS pace
  FROM cmp WHERE change_before_pct IS NOT NULL AND change_pct IS NOT NULL)
SELECT *, CASE WHEN turned >= places * 0.5 THEN 'reversal' WHEN held >= places * 0.6 THEN
  CASE WHEN up_share > 0.5 THEN 'continued rise' ELSE 'continued fall' END ELSE 'unclear' END AS reading FROM a WHERE places >= 3""")
def persistence(spark, sf):
    return I.persistence(comparison_of(spark, sf))


@query("idx_11_breadth", sql=COMPARE + """,
a AS (SELECT count(*) AS places, count(*) FILTER (WHERE change_pct < 0) AS falls, count(*) FILTER (WHERE change_pct > 0) AS rises
  FROM cmp WHERE change_pct IS NOT NULL)
SELECT *, CASE WHEN falls >= greatest(2, places * 0.7) THEN 'broad fall' WHEN rises >= greatest(2, places * 0.7) THEN 'broad rise'
  ELSE 'mixed' END AS shape FROM a""")
def breadth(spark, sf):
    return I.breadth(comparison_of(spark, sf))


@query("idx_11_level_spread", doubles="low high spread_ratio", sql=COMPARE + """,
r AS (SELECT *, row_number() OVER (ORDER BY level, region_uz) - 1 AS r, count(*) OVER () AS n FROM cmp WHERE level IS NOT NULL)
SELECT max(n) AS places, arg_min(region_uz, r) AS cheapest, min(level) AS low, arg_max(region_uz, r) AS dearest, max(level) AS high,
  max(region_uz) FILTER (WHERE r = n // 2) AS middle, max(level) / min(level) AS spread_ratio FROM r HAVING max(n) >= 3""")
def level_spread(spark, sf):
    return I.level_spread(comparison_of(spark, sf), "region_uz")


@query("idx_11_levels_shape", doubles="spread_ratio", sql=COMPARE + """,
a AS (SELECT count(*) AS places, arg_max(region_uz, (level, region_uz)) AS dearest, arg_min(region_uz, (level, region_uz)) AS cheapest,
  max(level) / min(level) AS spread_ratio, count(*) FILTER (WHERE level > (SELECT quantile_cont(level, 0.5) FROM cmp)) AS above_middle
  FROM cmp WHERE level IS NOT NULL)
SELECT *, CASE WHEN places < 3 THEN 'few' WHEN spread_ratio >= 2.5 THEN 'wide' WHEN above_middle <= places / 3 THEN 'stretched'
  ELSE 'even' END AS shape FROM a""")
def levels_shape(spark, sf):
    return I.levels_shape(comparison_of(spark, sf), "region_uz", "level")


@query("rpt_08_segment_headline", doubles="largest_move_pct", sql=COMPARE + """,
a AS (SELECT count(change_pct) AS places, count(*) FILTER (WHERE change_pct < 0) AS down,
  arg_max(region_uz, (abs(change_pct), region_uz)) FILTER (WHERE change_pct IS NOT NULL) AS moved_most,
  arg_max(change_pct, (abs(change_pct), region_uz)) FILTER (WHERE change_pct IS NOT NULL) AS largest_move_pct,
  arg_max(region_uz, (level, region_uz)) FILTER (WHERE level IS NOT NULL) AS dearest FROM cmp)
SELECT places, down, CASE WHEN down >= places * 0.7 THEN 'broad fall' WHEN down <= places * 0.3 THEN 'broad rise' ELSE 'mixed' END AS shape,
  moved_most, largest_move_pct, dearest FROM a""")
def segment_headline(spark, sf):
    return I.segment_headline(comparison_of(spark, sf), "region_uz")


@query("jn_07_quarter_self_join", doubles="now before change_pct", sql="WITH " + QUARTERLY + """
SELECT a.region_uz, a.market, a.quarter, a.median_usd_sqm AS now, b.median_usd_sqm AS before,
  (a.median_usd_sqm / b.median_usd_sqm - 1) * 100 AS change_pct
FROM quarterly a JOIN quarterly b ON a.region_uz = b.region_uz AND a.market = b.market AND a.quarter = b.quarter + INTERVAL 3 MONTH""")
def quarter_change(spark, sf):
    return I.quarter_change(balanced(spark, sf), ["region_uz", "market"])


@query("agg_21_market_movement", doubles="largest_fall largest_rise", sql="WITH " + QUARTERLY + """,
ks AS (SELECT quarter, row_number() OVER (ORDER BY quarter) - 1 AS k FROM (SELECT DISTINCT quarter FROM quarterly ORDER BY quarter DESC LIMIT 2)),
c AS (SELECT market, region_uz, max(median_usd_sqm) FILTER (WHERE k = 1) / max(median_usd_sqm) FILTER (WHERE k = 0) AS x
  FROM quarterly JOIN ks USING (quarter) GROUP BY 1, 2),
m AS (SELECT market, region_uz, (x - 1) * 100 AS move FROM c WHERE x IS NOT NULL)
SELECT market, count(*) AS places, count(*) FILTER (WHERE move < 0) AS down, min(move) AS largest_fall,
  arg_min(region_uz, (move, region_uz)) AS fall_place, max(move) AS largest_rise, arg_max(region_uz, (move, region_uz)) AS rise_place
FROM m GROUP BY 1""")
def movement(spark, sf):
    return I.movement(balanced(spark, sf))


@query("agg_23_change_band", doubles="low high", sql=COMPARE + """
SELECT count(change_pct) AS n, quantile_cont(abs(change_pct), 0.25) AS low, quantile_cont(abs(change_pct), 0.75) AS high FROM cmp""")
def change_band(spark, sf):
    return I.change_band(comparison_of(spark, sf))


# ---- as-of rates ------------------------------------------------------------

@query("jn_05_asof_backward", doubles="rate", sql="WITH " + FX + """,
d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
j AS (SELECT day, arg_max(rate, rate_date) AS rate, max(rate_date) AS rate_date FROM d JOIN fx
  ON rate_date BETWEEN day - 10 AND day GROUP BY 1)
SELECT day, rate, rate_date FROM d LEFT JOIN j USING (day)""")
def backward(spark, sf):
    days = table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    return asof.backward(days, fx_rates(spark, sf), [], "day", "rate_date", "rate", 10)


@query("jn_05_quarter_end_rates", doubles="rate", sql="""
WITH r AS (SELECT CAST(o_orderdate AS DATE) AS rate_date, avg(o_totalprice) AS rate FROM orders
  WHERE isodow(o_orderdate) <= 3 GROUP BY 1),
q AS (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter FROM orders),
e AS (SELECT quarter, CAST(quarter + INTERVAL 3 MONTH AS DATE) - 1 AS quarter_end FROM q)
SELECT quarter, quarter_end, arg_max(rate, rate_date) AS rate, max(rate_date) AS rate_date FROM e JOIN r
ON rate_date BETWEEN quarter_end - 10 AND quarter_end WHERE quarter_end <= DATE '2000-12-31' GROUP BY 1, 2""")
def quarter_end(spark, sf):
    orders = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    daily = orders.where(F.weekday("d") <= 2).groupBy(F.col("d").alias("rate_date")).agg(F.avg("o_totalprice").alias("rate"))
    return asof.quarter_end_rates(orders.select(F.trunc("d", "quarter").alias("quarter")), daily, "2000-12-31")


# ---- regional ---------------------------------------------------------------

GROUPS = "WITH " + PANEL + """,
b AS (SELECT metric, region, arg_max(value, date) AS latest, arg_min(value, date) AS first, max(value) AS peak, max(date) AS date
  FROM panel GROUP BY 1, 2),
y AS (SELECT b.metric, b.region, arg_min(p.value, (abs(p.date - CAST(b.date - INTERVAL 1 YEAR AS DATE)), p.date)) AS base FROM b
  JOIN panel p ON b.metric = p.metric AND b.region = p.region
  AND p.date BETWEEN CAST(b.date - INTERVAL 1 YEAR AS DATE) - 25 AND CAST(b.date - INTERVAL 1 YEAR AS DATE) + 25 GROUP BY 1, 2),
cmp AS (SELECT metric, region, latest, first, (latest / first - 1) * 100 AS change_pct, (latest / base - 1) * 100 AS yoy_pct, peak,
  (latest / peak - 1) * 100 AS from_peak_pct,
  CASE WHEN metric = 'transactions' THEN latest / sum(latest) OVER (PARTITION BY metric) * 100 END AS share_pct,
  CASE WHEN count(base) OVER (PARTITION BY metric) >= 2 THEN 'yoy_pct' ELSE 'change_pct' END AS ranked_by
  FROM b LEFT JOIN y USING (metric, region))"""


@query("agg_15_group_comparison", doubles="latest first change_pct yoy_pct peak from_peak_pct share_pct", sql=GROUPS + " SELECT * FROM cmp")
def compare(spark, sf):
    return R.compare(monthly_panel(spark, sf), "region", ["transactions"])


@query("jn_04_nearest_asof_25_days", doubles="yoy_pct", sql=GROUPS + " SELECT metric, region, yoy_pct FROM cmp")
def nearest_25(spark, sf):
    return R.compare(monthly_panel(spark, sf), "region", ["transactions"]).select("metric", "region", "yoy_pct")


@query("top_01_leaders_laggards", doubles="growth", sql=GROUPS + """,
r AS (SELECT metric, region, yoy_pct AS growth, row_number() OVER (PARTITION BY metric ORDER BY yoy_pct DESC NULLS LAST, region) AS r,
  count(*) OVER (PARTITION BY metric) AS n FROM cmp)
SELECT metric, 'leader' AS side, CAST(r AS INT) AS place, region, growth FROM r WHERE r <= 5
UNION ALL SELECT metric, 'laggard', CAST(n - r + 1 AS INT), region, growth FROM r WHERE r > n - 5""")
def leaders(spark, sf):
    return R.leaders_and_laggards(R.compare(monthly_panel(spark, sf), "region", ["transactions"]), "region")


@query("agg_15_group_spread", doubles="dispersion_pct spread_ratio", sql=GROUPS + """
SELECT metric, count(latest) AS groups, stddev_samp(latest) / avg(latest) * 100 AS dispersion_pct,
  CASE WHEN min(latest) > 0 THEN max(latest) / min(latest) END AS spread_ratio FROM cmp GROUP BY 1""")
def group_spread(spark, sf):
    return R.spread(R.compare(monthly_panel(spark, sf), "region", ["transactions"]))


CONVERGENCE = "WITH " + PANEL + """,
sp AS (SELECT s.metric, s.region, d.date FROM (SELECT metric, region, min(date) AS a FROM panel GROUP BY 1, 2) s
  JOIN (SELECT DISTINCT metric, date FROM panel) d ON s.metric = d.metric AND d.date >= s.a),
f AS (SELECT sp.metric, sp.date, last_value(value IGNORE NULLS) OVER (PARTITION BY sp.metric, sp.region ORDER BY sp.date
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM sp LEFT JOIN panel USING (metric, region, date)),
cv AS (SELECT metric, date, stddev_samp(value) / avg(value) AS cv, count(value) AS n FROM f GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY date) AS r, count(*) OVER (PARTITION BY metric) AS k FROM cv WHERE cv IS NOT NULL),
g AS (SELECT metric, max(k) AS periods, max(n) AS groups, avg(cv) FILTER (WHERE r <= k // 2) AS first_half,
  avg(cv) FILTER (WHERE r > k // 2) AS second_half FROM h GROUP BY 1),
c AS (SELECT *, (second_half / first_half - 1) * 100 AS change_pct FROM g)
SELECT *, CASE WHEN periods < 4 OR groups < 3 THEN 'unclear' WHEN change_pct < -8 THEN 'converging' WHEN change_pct > 8 THEN 'diverging'
  ELSE 'stable' END AS convergence FROM c"""


@query("agg_16_sigma_convergence", doubles="first_half second_half change_pct", digits=3, sql=CONVERGENCE)
def convergence(spark, sf):
    return R.convergence(monthly_panel(spark, sf), "region", ["transactions"])


# ---- drivers ----------------------------------------------------------------

DRIVER_ROLES = [("price", "price"), ("transactions", "volume"), ("income", "income"), ("discount", "rate"), ("tax", "inflation"),
                ("fx_like", "fx")]
DRIVER_ROLES_SQL = "roles(metric, role) AS (VALUES " + ", ".join(f"('{m}', '{r}')" for m, r in DRIVER_ROLES) + ")"
DRIVER_SERIES = NATIONAL + """,
li AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_discount) * 100 AS discount, avg(l_tax) * 100 AS tax,
  avg(l_extendedprice) AS fx_like FROM lineitem GROUP BY 1),
panel2 AS (SELECT metric, date, value FROM series UNION ALL SELECT 'discount', date, discount FROM li
  UNION ALL SELECT 'tax', date, tax FROM li UNION ALL SELECT 'fx_like', date, fx_like FROM li)"""
GROWTH = "WITH " + DRIVER_SERIES + """,
ax AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS periods FROM (SELECT DISTINCT date FROM panel2)),
fl AS (SELECT metric, quantile_cont(abs(value), 0.5) > 0 AND quantile_cont(abs(value), 0.5) < 100 AND min(value) > -100 AS points
  FROM panel2 GROUP BY 1),
rw AS (SELECT metric, date, value, pos, points, pos - CASE WHEN periods >= 28 THEN 12 ELSE 1 END AS bp FROM panel2
  JOIN ax USING (date) JOIN fl USING (metric)),
g AS (SELECT a.metric, a.date, a.pos, CASE WHEN a.points THEN a.value - b.value ELSE (a.value / nullif(b.value, 0) - 1) * 100 END AS growth
  FROM rw a JOIN rw b ON a.metric = b.metric AND a.bp = b.pos WHERE b.value <> 0 OR a.points)"""


def driver_panel(spark, sf):
    line = table(spark, sf, "lineitem").groupBy(F.trunc(F.to_date("l_shipdate"), "month").alias("date")).agg(
        (F.avg("l_discount") * 100).alias("discount"), (F.avg("l_tax") * 100).alias("tax"),
        F.avg("l_extendedprice").alias("fx_like"))
    extra = line.unpivot(["date"], ["discount", "tax", "fx_like"], "metric", "value")
    return national_panel(spark, sf).unionByName(extra)


def driver_roles(spark):
    return spark.createDataFrame(DRIVER_ROLES, "metric string, role string")


@query("drv_01_growth", doubles="growth", sql=GROWTH + " SELECT * FROM g")
def growth(spark, sf):
    return D.growth(driver_panel(spark, sf))


MATRIX = GROWTH + """,
mx AS (SELECT x.metric AS a, y.metric AS b, count(*) AS n, CASE WHEN count(*) >= 4 THEN corr(x.growth, y.growth) END AS r
  FROM g x JOIN g y USING (date) GROUP BY 1, 2)"""


@query("drv_02_correlation_matrix", doubles="r", sql=MATRIX + " SELECT * FROM mx")
def matrix(spark, sf):
    return D.correlation_matrix(D.growth(driver_panel(spark, sf)))


@query("drv_08_strongest_pair", doubles="r", sql=MATRIX + " SELECT * FROM mx WHERE a < b ORDER BY abs(r) DESC, a, b LIMIT 1")
def strongest(spark, sf):
    return D.strongest_pair(D.correlation_matrix(D.growth(driver_panel(spark, sf))))


LAGGED = GROWTH + "," + DRIVER_ROLES_SQL + """,
t AS (SELECT pos, growth AS y FROM g WHERE metric = 'price'),
bl AS (SELECT d.metric AS driver, role, k AS lag, count(*) AS n, corr(d.growth, y) AS r FROM g d JOIN roles USING (metric),
  (SELECT unnest(range(0, 7)) AS k) JOIN t ON true WHERE d.metric <> 'price' AND t.pos = d.pos + k GROUP BY 1, 2, 3),
us AS (SELECT *, max(CASE WHEN lag = 0 THEN n END) OVER (PARTITION BY driver) AS n0 FROM bl),
ok AS (SELECT * FROM us WHERE n >= 5 AND r IS NOT NULL AND lag <= n0 // 4)"""
LINKS = LAGGED + """,
l0 AS (SELECT driver, role, max(r) FILTER (WHERE lag = 0) AS correlation, max(n) FILTER (WHERE lag = 0) AS n,
  CAST(arg_max(lag, (abs(r), -lag)) AS INT) AS best_lag, arg_max(r, (abs(r), -lag)) AS best_lag_correlation FROM ok GROUP BY 1, 2),
links AS (SELECT *, CASE WHEN abs(correlation) >= 0.7 THEN 'strong' WHEN abs(correlation) >= 0.5 THEN 'moderate'
  WHEN abs(correlation) >= 0.3 THEN 'weak but visible' ELSE 'negligible' END AS strength,
  CASE WHEN correlation > 0 THEN 'positive' WHEN correlation < 0 THEN 'negative' ELSE 'none' END AS direction,
  CASE WHEN abs(correlation) >= 0.2 THEN sign(correlation) = CASE role WHEN 'rate' THEN -1 ELSE 1 END END AS consistent_with_theory FROM l0)"""


def links_of(spark, sf, with_p=False):
    return D.links(D.growth(driver_panel(spark, sf)), driver_roles(spark), "price", "price", with_p=with_p)


@query("drv_03_driver_links", doubles="correlation best_lag_correlation", sql=LINKS + """
SELECT driver, role, correlation, n, best_lag, best_lag_correlation FROM links""")
def links(spark, sf):
    return links_of(spark, sf).select("driver", "role", "correlation", "n", "best_lag", "best_lag_correlation")


@query("drv_03_link_significance")
def link_significance(spark, sf):
    return links_of(spark, sf, True)


@query("drv_04_strength_and_sign", sql=LINKS + " SELECT driver, strength, direction, consistent_with_theory FROM links")
def strength(spark, sf):
    return links_of(spark, sf).select("driver", "strength", "direction", "consistent_with_theory")


@query("drv_05_same_family", sql="WITH " + NATIONAL + ", " + ROLES_SQL + """
SELECT metric, 'price' AS role FROM (SELECT DISTINCT metric FROM series) WHERE metric = 'income'""")
def family(spark, sf):
    present = national_panel(spark, sf).select("metric").distinct()
    renamed = present.withColumn("role", F.when(F.col("metric") == "transactions", "volume").otherwise("price"))
    return D.excluded_drivers(renamed, "price", "price_per_sqm")


@query("jn_13_lagged_self_join", doubles="r", sql=LAGGED + " SELECT driver, CAST(lag AS INT) AS lag, n, r FROM bl")
def lagged(spark, sf):
    g = D.growth(driver_panel(spark, sf))
    t = g.where("metric = 'price'").select("pos", F.col("growth").alias("y"))
    d = g.where("metric <> 'price'").withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return d.select(F.col("metric").alias("driver"), "lag", (F.col("pos") + F.col("lag")).alias("pos"), "growth") \
        .join(t, "pos").groupBy("driver", "lag").agg(F.count("*").alias("n"), F.corr("growth", "y").alias("r"))


@query("drv_07_driver_regression")
def regression(spark, sf):
    g = measured(D.growth(driver_panel(spark, sf)))
    return D.regression(g, "price", D.links(g, driver_roles(spark), "price", "price", with_p=False), D.correlation_matrix(g))


@query("rpt_02_driver_table", doubles="correlation best_lag_correlation", sql=LINKS + """
SELECT * FROM links ORDER BY abs(correlation) DESC, driver LIMIT 14""")
def driver_table(spark, sf):
    from plinth.operators.report import driver_rows
    return driver_rows(links_of(spark, sf))


@query("rpt_02_regression_table")
def regression_table(spark, sf):
    from plinth.operators.report import regression_rows
    return regression_rows(regression(spark, sf))


@query("rul_01_market_flags", sql=CONVERGENCE.replace("SELECT *, CASE WHEN periods", """SELECT 'concentrated' AS code FROM (
  SELECT max(v) / sum(v) AS s FROM (SELECT region, sum(value) AS v FROM panel WHERE metric = 'transactions'
  AND date = (SELECT max(date) FROM panel WHERE metric = 'transactions') GROUP BY 1)) WHERE s > 0.4
UNION ALL SELECT DISTINCT 'diverging' FROM (SELECT *, CASE WHEN periods""") + ") WHERE convergence = 'diverging'")
def market_flags(spark, sf):
    from plinth.operators import cross_section as X
    from plinth.operators.report import market_rules
    rows = monthly_panel(spark, sf)
    conc = X.concentration(rows.where("metric = 'transactions'"), "region", "value", "date")
    none = rows.select(F.lit(0).alias("best_lag"), F.lit(False).alias("detected")).where("false")
    return market_rules(R.convergence(rows, "region", ["transactions"]), conc, none.select("best_lag"), none.select("detected"))


@query("rul_01_market_flags_all", sql=f"""SELECT code FROM ({ORACLES["rul_01_market_flags"]})
UNION ALL SELECT DISTINCT 'leading_indicator' FROM ({LINKS} SELECT * FROM links) WHERE best_lag > 0
UNION ALL SELECT DISTINCT 'seasonal' FROM ({ORACLES["ts_05_seasonal_effects"]}) WHERE detected""")
def market_flags_all(spark, sf):
    """All four rules have their tables; ``rul_01_market_flags`` gives two of them empty ones."""
    from plinth.operators import cross_section as X
    from plinth.operators import series as S
    from plinth.operators.report import market_rules
    rows = monthly_panel(spark, sf)
    conc = X.concentration(rows.where("metric = 'transactions'"), "region", "value", "date")
    return market_rules(R.convergence(rows, "region", ["transactions"]), conc, links_of(spark, sf), S.seasonal_effects(rows, ["metric", "region"]))
