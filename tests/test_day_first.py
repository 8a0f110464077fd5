"""Day-first dates of a whole column."""

import datetime

import pytest
from pyspark.sql import functions as F

from plinth.plans import dataset


@pytest.mark.parametrize("sep", ["/", "-"])
@pytest.mark.parametrize("day_first", [True, False])
def test_dates_follow_their_column(spark, sep, day_first):
    days = [datetime.date(2024, 1 + k % 12, 1 + k * 7 % 28) for k in range(40)]
    pattern = f"%d{sep}%m{sep}%Y" if day_first else f"%m{sep}%d{sep}%Y"
    df = spark.createDataFrame([(d.strftime(pattern), 100.0 + k) for k, d in enumerate(days)], "date string, price double")
    roles = spark.createDataFrame([("date", "date", 1.0), ("price", "price", 1.0)], "column_name string, role string, score double")
    assert dataset.has_day_first(df, "date") == day_first
    picked = dataset.profile.pick_columns
    try:
        dataset.profile.pick_columns = lambda _: spark.createDataFrame([("date", "date")], "role string, column_name string")
        tidy, _ = dataset.tidy_panel(df, roles, spark.createDataFrame([("price", True)], "column_name string, keep boolean"))
    finally:
        dataset.profile.pick_columns = picked
    found = {r.value: r.date for r in tidy.select("value", F.col("date")).collect()}
    assert found == {100.0 + k: d for k, d in enumerate(days)}


def test_analyse_finds_day_first_columns(spark):
    days = [datetime.date(2018 + k // 12, 1 + k % 12, 13 + k % 15) for k in range(48)]
    table = spark.createDataFrame([(d.strftime("%d/%m/%Y"), 100.0 + k) for k, d in enumerate(days)], "date string, avg_price_usd double")
    df, roles, verdicts = dataset.understand(table)
    tidy, _ = dataset.tidy_panel(df, roles, verdicts)
    assert sorted(r.date for r in tidy.collect()) == days
