"""Queries over the whole job, beside those that keep their SQL and a smaller one."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plinth.operators.listings import text_number
from tools.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["lst_03_text_and_float_all", "jn_01_full_outer_dates_overlap", "rul_01_market_flags_all",
                                  "agg_26_issue_counts_all", "rpt_13_rewritable_issues_all"])
def test_whole_job_matches_oracle(spark, name):
    status, n, _ = compare(spark, oracle_connection(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert status == "ok" and n > 0


def test_every_document_and_both_sides_are_there(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert entry.queries()["lst_03_text_and_float_all"](spark, SF).count() == documents
    out = entry.queries()["jn_01_full_outer_dates_overlap"](spark, SF)
    sides = out.groupBy(F.col("price").isNull(), F.col("income").isNull()).count().collect()
    assert {r[:2] for r in sides} == {(False, True), (False, False), (True, False)}


def test_text_numbers(spark):
    given = {"1": 1.0, "-2,5": -2.5, "+.5": 0.5, "3.": 3.0, "1e3": 1000.0, "1_000": 1000.0, "nan": None, "inf": None, "1d": None, "2f": None,
             "e": None, "": None, "_1": None, "1__0": None, "1e999": None, "0x1p3": None, "12\n": None}
    rows = spark.createDataFrame(list(given.items()), "text string, expected double").withColumn("found", text_number(F.col("text")))
    assert {r.text: r.found for r in rows.collect()} == given
