"""The given tables, and the property-market views derived from them.

Each view exists twice with one definition: as a DataFrame and as SQL text for the
oracle (``LISTINGS`` and friends are common table expressions to put after WITH).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem read as an advert (see FIXTURES.md, part B)."""
    line = spread(table(spark, sf_dir, "lineitem"))
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("listing_id"),
            F.to_date("o_orderdate").alias("date"),
            F.col("n_name").alias("region"),
            F.col("r_name").alias("macro_region"),
            F.col("c_mktsegment").alias("segment"),
            F.when(F.col("l_returnflag") == "R", "rent").otherwise("sale").alias("kind"),
            F.col("l_linestatus").alias("property"),
            F.col("o_orderstatus").alias("market"),
            F.when(F.col("l_suppkey") % 3 == 0, "B").otherwise("A").alias("source"),
            F.col("l_linenumber").cast("double").alias("rooms"),
            F.col("l_quantity").alias("total_area"),
            F.col("l_extendedprice").alias("price_usd"),
            F.try_divide("l_extendedprice", "l_quantity").alias("sqm_usd"),
        )
    )


LISTINGS = """listings AS (
  SELECT l_orderkey * 10 + l_linenumber AS listing_id, CAST(o_orderdate AS DATE) AS date,
         n_name AS region, r_name AS macro_region, c_mktsegment AS segment,
         CASE WHEN l_returnflag = 'R' THEN 'rent' ELSE 'sale' END AS kind,
         l_linestatus AS property, o_orderstatus AS market,
         CASE WHEN l_suppkey % 3 = 0 THEN 'B' ELSE 'A' END AS source,
         CAST(l_linenumber AS DOUBLE) AS rooms, l_quantity AS total_area,
         l_extendedprice AS price_usd, l_extendedprice / l_quantity AS sqm_usd
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy panel (date, region, segment, metric, value) of monthly order measures."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    wide = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("date"), F.col("n_name").alias("region"))
        .agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("transactions"),
             F.avg("c_acctbal").alias("income"))
    )
    return wide.unpivot(["date", "region"], ["price", "transactions", "income"], "metric", "value") \
        .select("date", "region", F.lit("All").alias("segment"), "metric", "value")


PANEL = """wide AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, n_name AS region,
         avg(o_totalprice) AS price, CAST(count(*) AS DOUBLE) AS transactions, avg(c_acctbal) AS income
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2),
panel AS (
  SELECT date, region, 'All' AS segment, 'price' AS metric, price AS value FROM wide
  UNION ALL SELECT date, region, 'All', 'transactions', transactions FROM wide
  UNION ALL SELECT date, region, 'All', 'income', income FROM wide)"""


def national_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel summed (transactions) or averaged (price, income) over regions."""
    from plinth.operators.panel import national_series
    return national_series(monthly_panel(spark, sf_dir), sum_metrics=["transactions"])


NATIONAL = PANEL + """,
series AS (
  SELECT metric, date, CASE WHEN metric = 'transactions' THEN sum(value) ELSE avg(value) END AS value
  FROM panel GROUP BY metric, date)"""


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive aggregate: quarter x region x market, from the listings themselves."""
    from plinth.operators.archive import aggregate_archive
    rows = listings(spark, sf_dir).where("kind = 'sale'").select(
        F.trunc("date", "month").alias("month"), F.col("region").alias("region_uz"), "market",
        F.col("region").alias("district"), F.col("price_usd").alias("price"), F.col("sqm_usd").alias("usd_sqm"))
    return aggregate_archive(rows, ["quarter", "region_uz", "market"])


QUARTERLY = LISTINGS + """,
quarterly AS (
  SELECT CAST(date_trunc('quarter', date) AS DATE) AS quarter, region AS region_uz, market,
         count(*) AS listings, count(DISTINCT date_trunc('month', date)) AS months,
         quantile_cont(sqm_usd, 0.5) AS median_usd_sqm, quantile_cont(price_usd, 0.5) AS median_usd
  FROM listings WHERE kind = 'sale' GROUP BY 1, 2, 3)"""


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rates on weekdays: the mean purchase value of each day, scaled."""
    events = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return (events.where((F.col("event_type") == "purchase") & F.weekday(day).isin(0, 1, 2, 3, 4))
            .groupBy(day.alias("rate_date")).agg(F.avg("value").alias("rate")))


FX = """fx AS (
  SELECT CAST(ts AS DATE) AS rate_date, avg(value) AS rate FROM events
  WHERE event_type = 'purchase' AND isodow(ts) <= 5 GROUP BY 1)"""
