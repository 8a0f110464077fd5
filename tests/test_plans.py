"""The three end-to-end runs on the given tables."""

import pytest
from pyspark.sql import functions as F

from plinth.plans.archive_index import archive_index
from plinth.plans.bulletin import bulletin
from plinth.plans.dataset import analyse
from workload.listing_queries import ads, raw_archive, second
from workload.tables import monthly_panel

SF = "/root/testdata/sf0.001"


def test_archive_index(spark):
    rates = spark.sql("SELECT explode(sequence(date'1995-01-01', date'2002-01-01')) AS rate_date, 12000.0D AS rate")
    cpi = spark.createDataFrame([(1995, 10.0)], "year int, pct double")
    out = archive_index(raw_archive(spark, SF), rates, "2002-01-01", cpi)
    levels = out["index"].orderBy("quarter").collect()
    assert levels[0]["index"] == pytest.approx(100.0) and len(levels) > 20
    assert out["real"].count() == len(levels)


def test_bulletin(spark):
    adverts = ads(spark, SF).withColumn("collection_category", F.concat("kind", F.lit("_apartment")))
    out = bulletin(adverts.withColumn("district", F.lit(None).cast("string")).drop("district"),
                   second(spark, SF))
    assert out["listings"].count() > 0
    assert {r.code for r in out["findings"].collect()} >= {"place", "cross_source", "repeat", "rooms", "classification", "outlier"}


def test_dataset(spark):
    wide = monthly_panel(spark, SF).groupBy("date", "region").pivot("metric", ["price", "transactions", "income"]).agg(F.max("value"))
    wide = wide.withColumnRenamed("price", "avg_price_usd").withColumnRenamed("income", "wage_usd")
    out = analyse(wide)
    assert {r.metric for r in out["summary"].collect()} == {"avg_price_usd", "transactions", "wage_usd"}
    assert out["drivers"].count() == 2
