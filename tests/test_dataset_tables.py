"""Datasets of several tables: dates from parts and numbers, the primary table, supporting metrics, holes in series."""

import datetime

import pytest
from pyspark.sql import functions as F

from plinth.functions.numbers import pearson
from plinth.functions.periods import from_parts
from plinth.operators import profile
from plinth.plans import dataset

MONTHS = [(2018 + k // 12, 1 + k % 12) for k in range(60)]


def dates(spark, rows, schema):
    df, roles, verdicts = dataset.understand(spark.createDataFrame(rows, schema))
    tidy, named = dataset.tidy_panel(df, roles, verdicts)
    return {r.value: r.date for r in tidy.where("metric LIKE '%price%'").collect()}, {r.metric for r in named.collect()}


@pytest.mark.parametrize("month", ["number", "name", "quarter"])
def test_year_and_parts(spark, month):
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    part = {"number": lambda m: m, "name": lambda m: names[m - 1], "quarter": lambda m: f"Q{(m + 2) // 3}"}[month]
    rows = [(y, part(m), 1000.0 + k) for k, (y, m) in enumerate(MONTHS)]
    kind = "int" if month == "number" else "string"
    found, metrics = dates(spark, rows, f"year int, {'quarter' if month == 'quarter' else 'month'} {kind}, avg_price_usd double")
    assert found == {1000.0 + k: datetime.date(y, (m - 1) // 3 * 3 + 1 if month == "quarter" else m, 1) for k, (y, m) in enumerate(MONTHS)}
    assert metrics == {"avg_price_usd"}


def test_parts_where_the_date_column_fails(spark):
    rows = [("soon" if k % 3 else f"{y}-{m:02d}", y, m, 1000.0 + k) for k, (y, m) in enumerate(MONTHS)]
    df = spark.createDataFrame(rows, "date string, year int, month int, price double")
    out, used = dataset.with_dates(df, "date")
    assert used == ["date", "month", "year"]
    assert [r.date for r in out.orderBy("price").collect()] == [datetime.date(y, m, 1) for y, m in MONTHS]
    out, used = dataset.with_dates(df.where("date <> 'soon'").withColumn("year", F.lit(None).cast("int")), "date")
    assert used == ["date"] and out.where("date IS NULL").isEmpty()


def test_a_missing_month_gives_no_date(spark):
    df = spark.createDataFrame([(2020, None, "Q4"), (2020, "3", "2"), (None, "3", "Q1"), (2020, "17", "Q7"), (2020, "March", None)], "y int, m string, q string")
    rows = df.select(from_parts(F.col("y"), F.col("m")).alias("m"), from_parts(F.col("y"), quarter=F.col("q")).alias("q")).collect()
    first = lambda m: datetime.date(2020, m, 1)
    assert [(r.m, r.q) for r in rows] == [(None, first(10)), (first(3), first(4)), (None, None), (first(12), None), (first(3), None)]


@pytest.mark.parametrize(("write", "day"), [("%Y%m", 1), ("%Y%m%d", 17)])
def test_numbers_as_dates(spark, write, day):
    days = [datetime.date(y, m, day) for y, m in MONTHS]
    found, _ = dates(spark, [(int(d.strftime(write)), 1000.0 + k) for k, d in enumerate(days)], "period long, price_usd double")
    assert found == {1000.0 + k: d for k, d in enumerate(days)}


def test_numbers_that_are_no_dates(spark):
    df = spark.createDataFrame([(1950.5, 190013, 5, None), (2000.0, 202501, 2000, None)], "a double, b long, c int, d int")
    assert {r.column_name: r.share for r in profile.numeric_dates(df, df.columns).collect()} == {"a": 0.0, "b": 0.5, "c": 0.0, "d": None}


def test_same_stem_pairs(spark):
    df = spark.range(40).selectExpr("id * 10.0 + 5 AS price1", "(id * 10.0 + 5) * 12000 AS price2", "pmod(id * 7919, 31) * 1.0 AS price3",
                                    "id + 20.0 AS area", "concat('2024-', id) AS t")
    _, roles, _ = dataset.understand(df)
    assert [r.columns for r in profile.stem_pairs(roles).collect()] == [["price1", "price2", "price3"]]
    found = {(r.a, r.b): r.kind for r in profile.pair_tests(df, roles).collect()}
    assert found == {("price1", "price2"): "unit conversion", ("price1", "price3"): "different", ("price2", "price3"): "different"}


def test_several_tables(spark):
    hole = (2020, 5)
    prices = spark.createDataFrame([(f"{y}-{m:02d}-01", r, 1000.0 + 10 * k) for k, (y, m) in enumerate(MONTHS) if (y, m) != hole for r in ("A", "B")],
                                   "date string, region string, avg_price_usd double")
    wages = spark.createDataFrame([(y, m, 300.0 + k, 5.0) for k, (y, m) in enumerate(MONTHS)], "year int, month int, wage_usd double, avg_price_usd double")
    notes = spark.createDataFrame([("a", "b")], "x string, y string")
    out = dataset.analyse_tables({"wages": wages, "prices": prices, "notes": notes})
    assert {(r.table_name, r.is_primary) for r in out["tables"].collect()} == {("prices", True), ("wages", False), ("notes", False)}
    assert {r.metric for r in out["summary"].collect()} == {"avg_price_usd", "wage_usd"}
    assert out["national"].where("metric = 'avg_price_usd'").agg(F.min("value")).first()[0] > 900  # the primary table's own metric
    assert out["panel"].where("metric = 'wage_usd'").count() == 20
    with pytest.raises(ValueError):
        dataset.analyse_tables({"notes": notes})


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 3.0), (4.0, 5.0, 9.0), (5.0, 5.0, 12.0), (7.0, 5.0, 18.0), (8.0, 5.0, 21.0)], "a double, b double, c double")
    assert df.select(pearson("a", "b").alias("r")).first().r is None
    assert df.select(pearson("a", "c").alias("r")).first().r == pytest.approx(1.0)
    assert [(r.n, r.r, r.kind) for r in profile.pair_test(df, "a", "b").collect()] == [(6, None, "different")]
