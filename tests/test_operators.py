"""Small frames with known answers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.functions import places
from plinth.functions.student_t import two_sided_p
from plinth.operators import archive, asof, bucketing, clean, cross_section, drivers, index, listings, pages, panel, quality
from plinth.operators import regional, seasonal, series, text_checks, windows
from plinth.sources import files, json_tables, sinks
from plinth.streaming import snapshots


def months(n, start=dt.date(2015, 1, 1)):
    return [dt.date(start.year + (start.month - 1 + i) // 12, (start.month - 1 + i) % 12 + 1, 1) for i in range(n)]


def as_series(spark, values, key="s", start=dt.date(2015, 1, 1)):
    return spark.createDataFrame([(key, d, float(v)) for d, v in zip(months(len(values), start), values)], "k string, date date, value double")


def test_summary_of_one_percent_a_month(spark):
    row = series.summary(as_series(spark, [100 * 1.01 ** i for i in range(37)]), ["k"]).first()
    assert row.yoy_pct == pytest.approx(12.68, abs=0.01) and row.direction == "rising" and row.grain == "monthly"


def test_rates_move_in_points(spark):
    roles = spark.createDataFrame([("s", "rate")], "k string, role string")
    row = series.summary(as_series(spark, [14.0] * 12 + [16.0] * 2), ["k"], roles).first()
    assert row.change_unit == "pp" and row.yoy_pp == pytest.approx(2.0)


def test_affordability_is_ten_years(spark):
    price = spark.createDataFrame([(dt.date(2024, 1, 1), 60000.0)], "date date, value double")
    income = spark.createDataFrame([(dt.date(2024, 1, 1), 500.0)], "date date, value double")
    assert series.affordability(price, income).first().affordability_years == pytest.approx(10.0)


def test_break_of_a_step_is_found_where_it_is(spark):
    row = series.breakpoints(as_series(spark, [100.0] * 30 + [150.0] * 30), ["k"]).collect()
    assert [(r.date, round(r.shift_pct)) for r in row] == [(months(31)[30], 50)]


def test_forecast_bounds_are_ordered(spark):
    s = as_series(spark, [100 + i + 10 * math.sin(i / 6 * math.pi) for i in range(72)])
    for r in seasonal.exponential_projection(s, ["k"], 6).collect() + series.line_projection(s, ["k"], 6).collect():
        assert r.lower < r.forecast < r.upper


def test_stl_sees_a_sine_and_no_noise_season(spark):
    rng = np.random.default_rng(1)
    both = as_series(spark, [100 + 20 * math.sin(2 * math.pi * i / 12) + rng.normal() for i in range(72)], "season") \
        .unionByName(as_series(spark, list(100 + rng.normal(size=72)), "noise"))
    got = {r.k: r for r in seasonal.stl_strength(both, ["k"]).collect()}
    assert got["season"].detected and got["season"].strength > 0.9 and got["noise"].strength < 0.7
    assert got["season"].peak_season in (3, 4, 5)


def test_p_values():
    assert two_sided_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert two_sided_p(0.0, 5) == 1.0 and two_sided_p(12.0, 30) < 1e-11


def test_driver_lead_of_four_periods_is_found(spark):
    rng = np.random.default_rng(5)
    steps = rng.normal(0, 3, 100)
    rate = 500 + np.cumsum(steps)
    price = [2000 - 8 * rate[max(i - 4, 0)] / 5 + rng.normal() for i in range(100)]
    rows = [("rate", d, float(v)) for d, v in zip(months(96), rate[4:])] + [("price", d, float(v)) for d, v in zip(months(96), price[4:])]
    panel_df = spark.createDataFrame(rows, "metric string, date date, value double")
    roles = spark.createDataFrame([("rate", "value"), ("price", "price")], "metric string, role string")
    link = drivers.links(drivers.growth(panel_df), roles, "price", "price").first()
    assert link.best_lag == 4 and link.best_lag_correlation < -0.8


def test_family_members_are_no_drivers(spark):
    roles = spark.createDataFrame([("deal", "price"), ("sqm", "price_per_sqm"), ("rate", "rate")], "metric string, role string")
    assert [r.metric for r in drivers.excluded_drivers(roles, "sqm", "price_per_sqm").collect()] == ["deal"]


def test_regression_recovers_coefficients(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 60)
    rows = []
    for i, d in enumerate(months(60)):
        rows += [("x", d, i, float(x[i])), ("y", d, i, float(3 * x[i] + 1 + rng.normal(0, .1)))]
    g = spark.createDataFrame(rows, "metric string, date date, pos int, growth double")
    roles = spark.createDataFrame([("x", "rate"), ("y", "price")], "metric string, role string")
    fit = {r.variable: r for r in drivers.regression(g, "y", drivers.links(g, roles, "y", "price"), drivers.correlation_matrix(g)).collect()}
    assert fit["x"].coefficient == pytest.approx(3, abs=.05) and fit["Intercept"].coefficient == pytest.approx(1, abs=.05)
    assert fit["x"].p_value < 1e-6 and fit["x"].r_squared > .99


def test_diverging_regions(spark):
    rows = [("price", f"r{j}", d, 100.0 + j * i) for i, d in enumerate(months(24)) for j in range(4)]
    df = spark.createDataFrame(rows, "metric string, region string, date date, value double")
    assert regional.convergence(df, "region").first().convergence == "diverging"


def test_regrain_zero_fills_volumes_only(spark):
    rows = [("a", "All", m, d, 1.0) for m in ("sales", "price") for d in (dt.date(2020, 1, 1), dt.date(2020, 8, 1))]
    df = spark.createDataFrame(rows, "region string, segment string, metric string, date date, value double")
    got = sorted((r.metric, str(r.date), r.value) for r in panel.regrain(df, ["sales"]).collect())
    assert got == [("price", "2020-01-01", 1.0), ("price", "2020-07-01", 1.0), ("sales", "2020-01-01", 1.0),
                   ("sales", "2020-04-01", 0.0), ("sales", "2020-07-01", 1.0)]


def test_nearest_tie_takes_the_earlier_date(spark):
    left = spark.createDataFrame([("k", dt.date(2024, 1, 10))], "k string, t date")
    right = spark.createDataFrame([("k", dt.date(2024, 1, 5), 1.0), ("k", dt.date(2024, 1, 15), 2.0)], "k string, d date, v double")
    assert asof.nearest(left, right, ["k"], "t", "d", "v", 20).first().base == 1.0
    assert asof.nearest(left, right, ["k"], "t", "d", "v", 4).first().base is None


def test_rates_walk_back_over_holidays_and_skip_the_future(spark):
    q = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 4, 1),), (dt.date(2024, 7, 1),)], "quarter date")
    rates = spark.createDataFrame([(dt.date(2024, 3, 25), 12500.0), (dt.date(2024, 6, 1), 12600.0), (dt.date(2024, 9, 30), 1.0)], "rate_date date, rate double")
    got = [(str(r.quarter), r.rate) for r in asof.quarter_end_rates(q, rates, "2024-08-01").collect()]
    assert got == [("2024-01-01", 12500.0)]


def quarterly(spark, rows):
    return spark.createDataFrame([(dt.date(*q), r, "Ikkilamchi", n, 3, float(m)) for q, r, n, m in rows],
                                 "quarter date, region_uz string, market string, listings int, months int, median_usd_sqm double")


def test_index_does_not_move_with_volumes(spark):
    rows = [((2024, 1, 1), "A", 900, 1000), ((2024, 1, 1), "B", 100, 500), ((2024, 4, 1), "A", 100, 1000), ((2024, 4, 1), "B", 900, 500)]
    assert [round(r["index"], 6) for r in index.index_series(quarterly(spark, rows)).orderBy("quarter").collect()] == [100.0, 100.0]
    weights = index.fixed_weights(quarterly(spark, rows)).agg(F.sum("weight")).first()[0]
    assert weights == pytest.approx(1.0)


def test_index_falls_back_to_volumes(spark):
    got = index.index_series(quarterly(spark, [((2024, 1, 1), "A", 100, 1000), ((2024, 4, 1), "B", 100, 500)])).orderBy("quarter").collect()
    assert [r.weighting for r in got] == ["volume", "volume"] and got[1]["index"] == pytest.approx(50.0)


def test_comparison_needs_every_rate_and_keeps_thin_rows(spark):
    q = quarterly(spark, [((2024, 1, 1), "A", 500, 1000), ((2024, 4, 1), "A", 500, 1100), ((2024, 7, 1), "A", 500, 1210), ((2024, 7, 1), "B", 3, 900)])
    rates = spark.createDataFrame([(dt.date(2024, 1, 1), 12000.0), (dt.date(2024, 4, 1), 12500.0), (dt.date(2024, 7, 1), 13000.0)], "quarter date, rate double")
    got = {r.region_uz: r for r in index.comparison(q, "region_uz", index.last_quarters(q), rates).collect()}
    assert got["A"].level_before == pytest.approx(13.75) and got["A"].level == pytest.approx(15.73)
    assert got["A"].change_pct == pytest.approx(14.4) and got["B"].level is None
    some = index.comparison(q, "region_uz", index.last_quarters(q), rates.where("rate < 13000")).collect()
    assert {r.region_uz: r.level for r in some}["A"] == 1210.0 and not some[0].local_currency


def test_deflator_carries_the_last_year_and_refuses_an_early_start(spark):
    q = spark.createDataFrame([(dt.date(2023, 10, 1),), (dt.date(2024, 10, 1),)], "quarter date")
    cpi = spark.createDataFrame([(2023, 10.0)], "year int, pct double")
    got = index.price_level(cpi, q).orderBy("quarter").collect()
    assert got[1].level == pytest.approx(1.1) and got[1].carried and not got[0].carried
    assert index.price_level(spark.createDataFrame([(2024, 10.0)], "year int, pct double"), q).count() == 0


def test_region_median_is_taken_over_adverts(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 1), "R", "M", d, p, p) for d, p in (("x", 500.0), ("x", 1000.0), ("x", 1000.0), ("y", 3000.0), ("y", 1000.0))],
                                 "month date, region_uz string, market string, district string, price double, usd_sqm double")
    assert archive.aggregate_archive(rows, ["month", "region_uz", "market"]).first().median_usd_sqm == 1000.0


def test_places(spark):
    df = spark.createDataFrame([("Ташкентская область", "Ташкент"), ("Toshkent shahri", None), ("Tashkent oblast", None), ("Farg`ona viloyati", None), (None, None)], "r string, c string")
    got = [r[0] for r in df.select(places.canonical_region("r", F.col("c"))).collect()]
    assert got == ["Toshkent shahri", "Toshkent shahri", "Toshkent Viloyati", "Farg'ona Viloyati", "Ko'rsatilmagan"]


def advert(i, price, currency, area=50.0, key="price"):
    v = dict(value=None, currency=None, negotiable=None, key=None, label=None)
    return dict(id=i, title="t", url=None, created_time="2024-05-01", business=False,
                location=dict(city=dict(name="C", normalized_name=None), region=dict(name=None, normalized_name="some-place")),
                params=[dict(key=key, value={**v, "value": str(price), "currency": currency}), dict(key="total_area", value={**v, "key": str(area)}),
                        dict(key="number_of_rooms", value={**v, "value": "2"})])


ADVERT = ("id int, title string, url string, created_time string, business boolean, location struct<city: struct<name: string, normalized_name: string>, "
          "region: struct<name: string, normalized_name: string>>, params array<struct<key: string, value: struct<value: string, currency: string, "
          "negotiable: boolean, key: string, label: string>>>")


def test_adverts_convert_bound_and_drop(spark):
    ads = spark.createDataFrame([advert(1, 2_500_000, "uzs"), advert(2, 300, "uye", 100000.0), advert(3, 1, "USD"), advert(4, 300, "EUR"), advert(5, 9, "usd", key="other")], ADVERT)
    rows = listings.advert_rows(ads)
    assert rows.count() == 4 and rows.first().region == "Some Place"
    clean_rows = {r.listing_id: r for r in listings.derive_and_clean(rows, 12_500, F.lit("rent")).collect()}
    assert set(clean_rows) == {1, 2}
    assert clean_rows[1].price_usd == 200.0 and clean_rows[1].price_per_sqm_usd == 4.0 and clean_rows[2].total_area is None
    assert listings.is_listing_feed(ads.schema) and listings.listing_type(ads, rows).first()[0] == "sale"


def test_second_source_sqm_price_becomes_a_total(spark):
    df = spark.createDataFrame([(1, "sale", 2000.0, "usd", "sqm", None, 60.0, "2+1", True), (2, "sale", 10.0, "usd", "sotka", None, 60.0, "2", None),
                                (3, "rent", 10.0, "usd", "all", "day", 60.0, "2", None)],
                               "id int, operationType string, price double, priceCurrency string, priceType string, pricePeriodUnit string, square double, room string, isNewBuilding boolean") \
        .withColumns({c: F.lit(None).cast("string") for c in ("property", "region", "city", "district", "createdAt")})
    got = listings.second_source_rows(df).collect()
    assert [(r.price, r.rooms, r.market) for r in got] == [(120000.0, 2.0, "Birlamchi")]


POOL = "listing_id int, source string, kind string, property string, region string, district string, rooms double, total_area double, price_usd double, sqm_usd double"


def test_audit_counts_every_screen(spark):
    base = ("sale", "Kvartira", "Andijon Viloyati", "d")
    rows = [(1, "A", *base, 2.0, 50.4, 50010.0, 1000.0), (2, "B", *base, 2.0, 50.3, 49990.0, 1000.0), (3, "A", *base, 3.0, 60.0, 60000.0, 1000.0),
            (4, "A", *base, 3.0, 60.0, 60000.0, 1000.0), (5, "A", *base, 40.0, 61.0, 61000.0, 1000.0), (6, "A", *base, 1.0, 62.0, 300.0, 5.0),
            (7, "A", "sale", "Kvartira", "Nowhere", "d", 1.0, 70.0, 70000.0, 1000.0)]
    cleaned, findings = quality.audit(spark.createDataFrame(rows, POOL))
    assert {r.code: r.affected for r in findings.collect()} == {"place": 1, "cross_source": 1, "repeat": 1, "rooms": 1, "classification": 1, "outlier": 0}
    kept = {r.listing_id: r for r in cleaned.collect()}
    assert set(kept) == {1, 3, 4, 5, 6, 7} and kept[5].rooms is None and kept[6].sqm_usd is None


def test_outliers_by_log_mad(spark):
    rows = [(i, "A", "sale", "K", "r", "d", 2.0, 50.0, 1.0, 1000.0 + i) for i in range(60)] + [(99, "A", "sale", "K", "r", "d", 2.0, 50.0, 1.0, 15000.0)]
    df = spark.createDataFrame(rows, POOL)
    flagged = quality.with_outlier_flag(df, quality.log_mad_bounds(df)).where("outlier").collect()
    assert [r.listing_id for r in flagged] == [99]


def test_thin_group_is_not_ranked(spark):
    rows = [("big", 100.0 + i % 5, 1.0, 1.0) for i in range(40)] + [("mid", 300.0, 1.0, 1.0)] * 35 + [("tiny", 9999.0, 1.0, 1.0)] * 3
    df = spark.createDataFrame(rows, "region string, price_usd double, sqm_usd double, total_area double")
    r = cross_section.ranking(cross_section.group_stats(df, "region"), "region").first()
    assert r.most_expensive == "mid" and r.cheapest == "big" and r.reliable_groups == 2


def test_windows_and_gaps(spark):
    df = spark.createDataFrame([("k", dt.date(2024, m, 1)) for m in (1, 2, 6, 7, 9)], "k string, month date")
    gaps = [(str(r.gap_start), str(r.gap_end), r.months) for r in windows.gap_islands(windows.missing_periods(df, ["k"]), ["k"]).orderBy("gap_start").collect()]
    assert gaps == [("2024-03-01", "2024-05-01", 3), ("2024-08-01", "2024-08-01", 1)]


def test_messy_numbers_names_and_lists(spark):
    df = spark.createDataFrame([("1 234,5", "12%", "x"), ("$2,5", "3 %", "y")], "price string, rate string, name string")
    assert [tuple(r) for r in clean.coerce_numeric_text(df).collect()] == [(1234.5, 12.0, "x"), (2.5, 3.0, "y")]
    assert clean.safe_columns(spark.createDataFrame([(1, 2)], "`A b` int, `a-b` int")).columns == ["a_b", "a_b_2"]
    lists = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [], [])], "id int, x array<int>, y array<string>")
    assert sorted(map(tuple, clean.explode_parallel_arrays(lists).collect()), key=str) == [(1, 1, "a"), (1, 2, "b"), (2, None, None)]


def test_text_checks(spark):
    p = spark.createDataFrame([(1, 0, "Narx 5 foiz oshdi."), (1, 1, "one two three four five six seven"), (2, 0, "zero one two three four five six"),
                               (2, 1, "Narx 5 foizga tushdi, chunki talab kam.")], "doc_id bigint, par int, text string")
    assert [(r.doc_id, r.run) for r in text_checks.repeated_runs(p).collect()] == [(2, "one two three four five six")]
    assert [(r.doc_id, r.par) for r in text_checks.flat_paragraphs(p).collect()] == [(1, 0)]
    pair = spark.createDataFrame([("narx 5 va 7,5", "5 edi")], "answer string, source string")
    assert text_checks.unsupported_numbers(pair).first().unsupported == ["7,5"]
    text = spark.createDataFrame([("2025-yil II choragida 5 foiz",)], "text string")
    assert text.select(text_checks.masked("text")).first()[0] == "[[F0]] [[F1]] foiz"


def test_pages(spark):
    html = '<script>window.__PRERENDERED_STATE__ = {"offers":[{"id":7,"params":[],"location":{"c":1},"title":"a"}]};</script><li data-id="0042"></li>'
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [(r.id, r.title) for r in pages.embedded_offers(df).collect()] == [("7", "a")]
    assert df.select(pages.card_ids("html")).first()[0] == ["42"]
    assert pages.rule_pattern("/a*b$") == "^/a.*b$"


def test_buckets_partition_the_input(spark):
    rows = spark.range(5000).select(F.lit("r").alias("region"), F.when(F.col("id") < 2000, "c1").otherwise("c2").alias("city"),
                                    (F.col("id") % 997 + 1000).cast("double").alias("price"))
    b = bucketing.capacity_buckets(rows, ["region", "city"], "price", 300).where("rows > 0")
    assert b.agg(F.sum("rows")).first()[0] == 5000 and b.where("rows > 300").count() == 0
    spans = sorted((r.low, r.high) for r in b.where("city = 'c2'").collect())
    assert all(a[1] < c[0] for a, c in zip(spans, spans[1:]))


def test_json_shapes_and_damaged_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "total": 2,\n "data": [{"id": 1, "p": {"x": 2}}, {"id": 2, "p": {"x": 3}}]\n}')
    assert json_tables.read_json(spark, str(tmp_path / "a.json"))["data"].columns == ["id", "p_x"]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{"id": \n{"id": 3}\n')
    rows, counts = json_tables.read_json_lines(spark, str(tmp_path / "b.jsonl"))
    assert rows.count() == 2 and counts.first()[:] == (1, 3)


def test_folder_lists_bad_files_and_redacts(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "f"))
    (tmp_path / "f" / "broken.parquet").write_bytes(b"not a parquet file")
    good = next((tmp_path / "f").glob("part-*.parquet"))
    schema_first = spark.read.parquet(str(good)).schema
    assert schema_first.names == ["id"]
    found = files.discover(spark, str(tmp_path / "f"), ("parquet",))
    assert found.count() == 2
    assert files.redacted("jdbc:x://u:p@h/db?password=1") == "jdbc:x://***@h/db?password=***"


def test_published_tables_are_all_or_nothing(spark, tmp_path):
    one = spark.createDataFrame([(dt.date(2024, 1, 1), "r", "m", 1)], "month date, region_uz string, market string, listings int")
    sinks.write_published({"monthly": one}, str(tmp_path / "p"))
    assert sinks.read_published(spark, str(tmp_path / "p")) is None


def test_observation_log_is_idempotent_and_keeps_repricing(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 1), "sale", 100.0), (1, dt.date(2024, 1, 8), "sale", 90.0)],
                                 "listing_id int, captured_at date, category string, price double")
    for _ in range(3):
        snapshots.append_new(rows, log)
    got = spark.read.parquet(log)
    assert got.count() == 2 and snapshots.repricings(got).first().price == 90.0
    h = snapshots.listing_history(got).first()
    assert (h.observations, str(h.first_seen), str(h.last_seen)) == (2, "2024-01-01", "2024-01-08")
