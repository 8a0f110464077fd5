"""Column understanding, ranks, top-k, sets and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import periods as D
from plinth.operators import order_stats as O
from plinth.operators import profile as P
from plinth.operators import report as R
from plinth.operators import sets as S
from plinth.operators import topk as K
from plinth.operators import translate as T
from plinth.plans.dataset import tidy_panel, understand
from workload.registry import query
from workload.tables import LISTINGS, PANEL, listings, monthly_panel, table

WITH = "WITH " + LISTINGS


def _column_sql(name, dtype, numeric):
    v = f"CAST({name} AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{name}' AS column_name, '{dtype}' AS dtype, count(*) AS rows, count({name}) AS non_null,
  (count(*) - count({name})) * 100.0 / count(*) AS missing_pct, count(DISTINCT {name}) AS distinct_values, min({v}) AS minimum,
  max({v}) AS maximum, avg({v}) AS mean FROM part"""


PART = [("p_partkey", "bigint", True), ("p_name", "string", False), ("p_brand", "string", False), ("p_type", "string", False),
        ("p_size", "int", True), ("p_retailprice", "double", True)]
PROFILE = " UNION ALL ".join(_column_sql(*c) for c in PART)


@query("prf_01_column_profile", doubles="missing_pct minimum maximum mean", sql=PROFILE)
def column_profile(spark, sf):
    return P.profile_columns(table(spark, sf, "part")).drop("samples")


@query("prf_01_samples", sql="""
SELECT 'p_brand' AS column_name, list_sort(list(v)) AS samples FROM (SELECT DISTINCT p_brand AS v FROM part ORDER BY v LIMIT 5)
UNION ALL SELECT 'p_type', list_sort(list(v)) FROM (SELECT DISTINCT p_type AS v FROM part ORDER BY v LIMIT 5)""")
def samples(spark, sf):
    return P.profile_columns(table(spark, sf, "part").select("p_brand", "p_type")).select("column_name", "samples")


@query("prf_02_column_roles")
def column_roles(spark, sf):
    df = listings(spark, sf).withColumnRenamed("sqm_usd", "price_per_sqm_usd")
    return P.classify_table(df).select("column_name", "role", "unit", "confidence")


PERIODS = ["'{y}Q{q}'", "'Q{q} {y}'", "'{y}-M{m}'", "'{y}-{m}'", "'Jan {y}'", "'{y} янв'", "'{y}-{m}-15'", "'x{y}'"]


def period_texts(spark, sf):
    d = F.to_date("o_orderdate")
    y, q, m = F.year(d).cast("string"), F.quarter(d).cast("string"), F.date_format(d, "MM")
    k = F.col("o_orderkey") % 8
    text = (F.when(k == 0, F.concat(y, F.lit("Q"), q)).when(k == 1, F.concat(F.lit("Q"), q, F.lit(" "), y))
            .when(k == 2, F.concat(y, F.lit("-M"), m)).when(k == 3, F.concat(y, F.lit("_"), m))
            .when(k == 4, F.concat(F.lit("Jan "), y)).when(k == 5, F.concat(y, F.lit(" янв")))
            .when(k == 6, F.date_format(d, "dd.MM.yyyy")).otherwise(F.concat(F.lit("x"), y)))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text"))


PARSED = """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN CAST(date_trunc('quarter', o_orderdate) AS DATE)
  WHEN 1 THEN CAST(date_trunc('quarter', o_orderdate) AS DATE) WHEN 2 THEN CAST(date_trunc('month', o_orderdate) AS DATE)
  WHEN 3 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 4 THEN make_date(year(o_orderdate), 1, 1)
  WHEN 5 THEN make_date(year(o_orderdate), 1, 1) WHEN 6 THEN CAST(o_orderdate AS DATE) END AS period FROM orders"""


@query("prf_04_period_parse", sql=PARSED)
def period_parse(spark, sf):
    return period_texts(spark, sf).select("o_orderkey", D.period_date(F.col("text"), day_first=True).alias("period"))


@query("prf_03_plausible_dates", doubles="share", sql=f"""
SELECT 'text' AS column_name, count(period) * 1.0 / count(*) AS share, count(period) * 1.0 / count(*) > 0.8 AS plausible FROM ({PARSED})""")
def plausible(spark, sf):
    return P.plausible_dates(period_texts(spark, sf), ["text"])


@query("prf_05_year_quarter_columns", sql="""
SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS by_quarter, CAST(date_trunc('month', o_orderdate) AS DATE) AS by_month, count(*) AS n
FROM orders GROUP BY 1, 2""")
def year_quarter(spark, sf):
    d = F.to_date("o_orderdate")
    rows = table(spark, sf, "orders").select(F.year(d).alias("year"), F.concat(F.lit("Q"), F.quarter(d)).alias("q"), F.month(d).alias("m"))
    return rows.groupBy(D.from_parts(F.col("year"), quarter=F.col("q")).alias("by_quarter"),
                        D.from_parts(F.col("year"), month=F.col("m").cast("string")).alias("by_month")).agg(F.count("*").alias("n"))


@query("prf_05_parts_in_the_panel", doubles="value", sql="""
SELECT make_date(year(o_orderdate), month(o_orderdate), 1) AS date, count(*) AS n, sum(o_totalprice) AS value FROM orders GROUP BY 1""")
def parts_in_the_panel(spark, sf):
    """A table without a date column: its year and month columns are found, joined and left out of the metrics."""
    d = F.to_date("o_orderdate")
    rows = table(spark, sf, "orders").select(F.year(d).alias("Year"), F.month(d).alias("Month"), F.col("o_totalprice").alias("avg_price_usd"))
    tidy, _ = tidy_panel(*understand(rows))
    return tidy.groupBy("date").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


@query("prf_03_numeric_dates", doubles="share", sql="""
SELECT 'day' AS column_name, 1.0 AS share UNION ALL SELECT 'month', 1.0 UNION ALL SELECT 'year', 1.0
UNION ALL SELECT 'o_orderkey', 0.0 UNION ALL SELECT 'o_totalprice', 0.0
UNION ALL SELECT 'odd', count(*) FILTER (WHERE o_orderkey % 5 <> 0) * 1.0 / count(*) FROM orders""")
def numeric_dates(spark, sf):
    d = F.to_date("o_orderdate")
    as_number = lambda p: F.date_format(d, p).cast("bigint")
    odd = F.when(F.col("o_orderkey") % 5 == 0, F.year(d) * 100 + 13).otherwise(as_number("yyyyMM"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", as_number("yyyyMMdd").alias("day"), as_number("yyyyMM").alias("month"),
                                             F.year(d).alias("year"), odd.alias("odd"))
    return P.numeric_dates(rows, rows.columns)


@query("prf_04_numeric_periods", sql="""
SELECT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, make_date(year(o_orderdate), 1, 1) AS year, count(*) AS n
FROM orders GROUP BY 1, 2, 3""")
def numeric_periods(spark, sf):
    d = F.to_date("o_orderdate")
    rows = table(spark, sf, "orders").select(F.date_format(d, "yyyyMMdd").cast("bigint").alias("a"), F.date_format(d, "yyyyMM").cast("bigint").alias("b"),
                                             F.year(d).alias("c"))
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c in "abc" for n, f in (("lo", F.min), ("hi", F.max))])
    at = lambda c: D.numeric_period(F.col(c), ends.select(f"lo_{c}").scalar(), ends.select(f"hi_{c}").scalar())
    return rows.groupBy(at("a").alias("day"), at("b").alias("month"), at("c").alias("year")).agg(F.count("*").alias("n"))


NUMBERED = "SELECT p_retailprice AS a, p_retailprice * 12.5 AS b, CAST(p_size AS DOUBLE) AS c FROM part"


@query("prf_10_numbered_pairs", doubles="r ratio_cv", sql=" UNION ALL ".join(f"""
SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({x}, {y}) AS r, stddev_pop({x} / {y}) / avg({x} / {y}) AS ratio_cv,
  CASE WHEN stddev_pop({x} / {y}) / avg({x} / {y}) < 0.02 AND corr({x}, {y}) > 0.98 THEN 'unit conversion'
  WHEN corr({x}, {y}) > 0.9 THEN 'related' ELSE 'different' END AS kind FROM ({NUMBERED}) AS t"""
    for a, b, x, y in (("price1", "price2", "a", "b"), ("price1", "price3", "a", "c"), ("price2", "price3", "b", "c"))))
def numbered_pairs(spark, sf):
    """price1, price2, price3: one stem, every two of them compared over the whole table."""
    rows = table(spark, sf, "part").select(F.col("p_retailprice").alias("price1"), (F.col("p_retailprice") * 12.5).alias("price2"),
                                           F.col("p_size").cast("double").alias("price3"))
    return P.pair_tests(rows, P.classify_table(rows)).drop("median_ratio")


@query("prf_07_pick_columns")
def pick_columns(spark, sf):
    return P.pick_columns(P.classify_table(listings(spark, sf)))


SCORES = """SELECT 'orders' AS table_name, count(*) AS rows, true AS has_date, false AS has_region, true AS has_segment, 1 AS metrics, true AS has_price, 'daily' AS grain FROM orders
UNION ALL SELECT 'part', count(*), false, false, true, 2, true, 'none' FROM part
UNION ALL SELECT 'nation', count(*), false, true, false, 0, false, 'none' FROM nation"""


def table_facts(spark, sf):
    def row(name, d, r, s, m, p, g):
        return table(spark, sf, name).agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(d).alias("has_date"), F.lit(r).alias("has_region"), F.lit(s).alias("has_segment"),
            F.lit(m).alias("metrics"), F.lit(p).alias("has_price"), F.lit(g).alias("grain"))
    return row("orders", True, False, True, 1, True, "daily").unionByName(row("part", False, False, True, 2, True, "none")) \
        .unionByName(row("nation", False, True, False, 0, False, "none"))


SCORE_SQL = f"""WITH f AS ({SCORES}), s AS (SELECT *, CAST(has_date AS INT) * 40 + CAST(has_region AS INT) * 15 + CAST(has_segment AS INT) * 8
  + 10 * least(metrics, 6) + least(rows / 50.0, 25.0) + CAST(has_price AS INT) * 25 AS score FROM f)"""


@query("prf_08_table_score", doubles="score", sql=SCORE_SQL + """
SELECT table_name, score, row_number() OVER (ORDER BY score DESC, table_name) = 1 AS is_primary FROM s""")
def table_score(spark, sf):
    return P.table_scores(table_facts(spark, sf)).select("table_name", "score", "is_primary")


@query("rpt_04_source_overview", doubles="score", sql=SCORE_SQL + """
SELECT table_name, rows, metrics AS columns, grain, score, score = max(score) OVER () AS selected FROM s""")
def source_overview(spark, sf):
    return R.source_overview(P.table_scores(table_facts(spark, sf)).withColumnRenamed("metrics", "columns"))


@query("prf_09_role_overrides")
def role_overrides(spark, sf):
    forced = spark.createDataFrame([("property", "segment")], "column_name string, role string")
    return P.classify_table(listings(spark, sf), forced).select("column_name", "role", "confidence")


@query("prf_10_unit_pair_test", doubles="r ratio_cv median_ratio", sql="""
WITH b AS (SELECT l_extendedprice AS a, l_extendedprice * 12650 + l_quantity AS b FROM lineitem), q AS (SELECT *, a / b AS q FROM b)
SELECT count(*) AS n, corr(a, b) AS r, stddev_pop(q) / avg(q) AS ratio_cv, quantile_cont(q, 0.5) AS median_ratio,
  CASE WHEN stddev_pop(q) / avg(q) < 0.02 AND corr(a, b) > 0.98 THEN 'unit conversion' WHEN corr(a, b) > 0.9 THEN 'related' ELSE 'different' END AS kind FROM q""")
def pair_test(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("price_usd"),
                                             (F.col("l_extendedprice") * 12650 + F.col("l_quantity")).alias("price_uzs"))
    return P.pair_test(df, "price_usd", "price_uzs")


@query("prf_11_glossary")
def glossary(spark, sf):
    return P.glossary(P.classify_table(listings(spark, sf)))


@query("prf_12_relevance_screen", sql="""
SELECT * FROM (VALUES ('p_partkey', 'identifier', false, 'one whole number per row', false), ('p_size', 'value', true, NULL, false), ('p_retailprice', 'price', true, NULL, false),
  ('photo_count', 'volume', false, 'advert media', false), ('nothing', 'value', false, 'no values', false))
AS t(column_name, role, keep, reason, abandoned) WHERE (SELECT count(*) FROM part) > 20""")
def relevance(spark, sf):
    df = table(spark, sf, "part").withColumn("photo_count", F.length("p_name")).withColumn("nothing", F.lit(None).cast("double"))
    roles = {"p_partkey": "identifier", "p_size": "value", "p_retailprice": "price", "photo_count": "volume", "nothing": "value"}
    m = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    profile = P.profile_columns(df).withColumn("role", F.try_element_at(m, F.col("column_name")))
    return P.relevance(profile)


@query("jn_09_anti_join_excluded_metrics", doubles="value", sql="WITH " + PANEL + " SELECT metric, date, region, value FROM panel WHERE metric <> 'transactions'")
def anti_join(spark, sf):
    verdicts = table(spark, sf, "region").agg(F.count("*")).select(F.inline(F.array(
        F.struct(F.lit("transactions").alias("column_name"), F.lit(False).alias("keep")), F.struct(F.lit("price").alias("column_name"), F.lit(True).alias("keep")))))
    return P.apply_relevance(monthly_panel(spark, sf), verdicts).select("metric", "date", "region", "value")


SPEARMAN = """r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM p)"""


@query("prf_13_numeric_association", doubles="association", sql=WITH + ", p AS (SELECT total_area AS x, price_usd AS y FROM listings), " + SPEARMAN + """
SELECT 'total_area' AS name, count(*) AS observations, corr(a, b) AS association, abs(corr(a, b)) >= 0.15 AS selected FROM r""")
def numeric_association(spark, sf):
    return P.numeric_association(listings(spark, sf), "total_area", "price_usd")


@query("prf_13_label_association", doubles="association", sql="WITH p AS (SELECT n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)), " + SPEARMAN + """
SELECT 'n_chars' AS name, count(*) AS observations, corr(a, b) AS association, abs(corr(a, b)) >= 0.15 AS selected FROM r""")
def label_association(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return P.numeric_association(rows, "n_chars", "quality")


@query("prf_13_category_association", doubles="median_price", sql=WITH + """
SELECT 'region' AS name, region AS category, count(*) AS observations, quantile_cont(price_usd, 0.5) AS median_price FROM listings GROUP BY 2 HAVING count(*) >= 15""")
def category_association(spark, sf):
    return P.category_association(listings(spark, sf), "region", "price_usd")


@query("prf_13_refusals")
def refusals(spark, sf):
    return P.refusals(P.classify_table(listings(spark, sf)), "price_usd")


@query("prf_14_coverage_record", sql="WITH " + PANEL + """
SELECT count(*) AS rows, count(DISTINCT date) AS periods, count(DISTINCT metric) AS metrics, count(DISTINCT region) AS regions, min(date) AS start, max(date) AS "end" FROM panel""")
def coverage(spark, sf):
    return P.coverage_record(monthly_panel(spark, sf))


@query("win_09_average_rank", doubles="avg_rank", sql=WITH + """
SELECT DISTINCT kind, total_area, count(*) OVER (PARTITION BY kind, total_area) AS n,
  rank() OVER (PARTITION BY kind ORDER BY total_area) + (count(*) OVER (PARTITION BY kind, total_area) - 1) / 2.0 AS avg_rank FROM listings""")
def average_rank(spark, sf):
    return O.average_ranks(listings(spark, sf), "total_area", ["kind"])


# ---- translation ------------------------------------------------------------

WORDS = {"automobile": "avtomobil", "building": "bino", "furniture": "mebel", "machinery": "mashina"}


@query("trn_01_translate_categories", sql="""
SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Avtomobil' WHEN 'BUILDING' THEN 'Bino' WHEN 'FURNITURE' THEN 'Mebel' WHEN 'MACHINERY' THEN 'Mashina'
  ELSE c_mktsegment END AS c_mktsegment, c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') AS c_mktsegment_resolved, count(*) AS n FROM customer GROUP BY 1, 2""")
def translate(spark, sf):
    return T.translate_column(table(spark, sf, "customer"), "c_mktsegment", WORDS) \
        .groupBy("c_mktsegment", "c_mktsegment_resolved").agg(F.count("*").alias("n"))


@query("trn_02_language_hint", sql=r"""
SELECT doc_id, regexp_matches(text, '\p{Cyrillic}') OR regexp_matches(lower(text), '(lik|lar|ning|dan|ga|da|siz|chi|cha)$') AS hinted FROM documents""")
def language_hint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.needs_translation(F.col("text"), {}).alias("hinted"))


# ---- top-k and sets ---------------------------------------------------------

BY_REGION = WITH + ", g AS (SELECT region, avg(price_usd) AS price FROM listings GROUP BY 1)"


def by_region(spark, sf):
    return listings(spark, sf).groupBy("region").agg(F.avg("price_usd").alias("price"))


@query("top_02_both_extremes", doubles="price", sql=BY_REGION + """
SELECT region, price, 'low' AS side FROM (SELECT * FROM g ORDER BY price, region LIMIT 4) UNION ALL
SELECT region, price, 'high' FROM (SELECT * FROM g ORDER BY price DESC, region DESC LIMIT 4)""")
def extremes(spark, sf):
    return K.extremes(by_region(spark, sf), "price", "region", 4)


@query("top_03_top_n", doubles="price_usd", sql=WITH + " SELECT listing_id, region, price_usd FROM listings ORDER BY price_usd DESC, listing_id, region LIMIT 20")
def top_n(spark, sf):
    return K.top_n(listings(spark, sf).select("listing_id", "region", "price_usd"), 20, F.desc("price_usd"), "listing_id", "region")


@query("top_04_cheapest_dearest", doubles="price", sql=BY_REGION + """
SELECT 'cheapest' AS side, region, price FROM (SELECT * FROM g ORDER BY price, region LIMIT 3) UNION ALL
SELECT 'dearest', region, price FROM (SELECT * FROM g ORDER BY price DESC, region LIMIT 3)""")
def cheapest(spark, sf):
    return K.cheapest_and_dearest(by_region(spark, sf), "price", "region")


@query("top_05_largest_move", doubles="change", sql="WITH " + PANEL + """,
c AS (SELECT metric, region, (arg_max(value, date) / arg_min(value, date) - 1) * 100 AS change FROM panel GROUP BY 1, 2)
SELECT metric, arg_max(region, (abs(change), region)) AS region, arg_max(change, (abs(change), region)) AS change FROM c GROUP BY 1""")
def largest_move(spark, sf):
    c = monthly_panel(spark, sf).groupBy("metric", "region").agg(
        ((F.max_by("value", "date") / F.min_by("value", "date") - 1) * 100).alias("change"))
    return K.largest_move(c, "change", "region", ["metric"])


@query("top_06_thin_keep_last", doubles="price", sql=WITH + """,
m AS (SELECT year(date) * 12 + month(date) AS month_no, avg(price_usd) AS price FROM listings GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY month_no) AS row_no, count(*) OVER () AS n FROM m)
SELECT month_no, price, row_no FROM n WHERE n <= 24 OR (row_no - 1) % CAST(ceil(n / 23.0) AS BIGINT) = 0 OR row_no = n""")
def thin_keep_last(spark, sf):
    m = listings(spark, sf).groupBy((F.year("date") * 12 + F.month("date")).alias("month_no")).agg(F.avg("price_usd").alias("price"))
    return K.thin_keep_last(m, "month_no")


@query("top_08_top_per_group", doubles="price_usd", sql=WITH + """
SELECT region, listing_id, price_usd, place FROM (SELECT region, listing_id, price_usd,
  CAST(row_number() OVER (PARTITION BY region ORDER BY price_usd DESC, listing_id) AS INT) AS place FROM listings) WHERE place <= 5""")
def top_per_group(spark, sf):
    return K.top_per_group(listings(spark, sf).select("region", "listing_id", "price_usd"), ["region"], "price_usd", "listing_id", 5)


@query("src_16_systematic_thinning", sql="""
SELECT o_orderkey, row_no FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_no, count(*) OVER () AS n FROM orders)
WHERE (row_no - 1) % CAST(ceil(n / 1000.0) AS BIGINT) = 0""")
def systematic(spark, sf):
    return K.thin_systematic(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1000)


QUOTAS = """counts AS (SELECT event_type AS file, CASE WHEN event_type <> 'view' THEN count(*) END AS rows FROM events GROUP BY 1),
facts AS (SELECT sum(rows)::DOUBLE AS known, count(*) AS files, count(rows) AS counted, 4000.0::DOUBLE / count(*) AS equal FROM counts),
quotas AS (SELECT file, rows, greatest(1, coalesce(least(floor((4000.0::DOUBLE - equal * (files - counted)) * rows / known), rows), floor(equal)))::BIGINT AS quota
           FROM counts, facts)"""


def event_quotas(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("file")).agg(F.count("*").alias("rows"))
    return K.budget_quotas(counts.withColumn("rows", F.when(F.col("file") != "view", F.col("rows"))), 4000)


@query("src_17_budget_by_file", sql=f"WITH {QUOTAS} SELECT file, rows, quota FROM quotas")
def budget(spark, sf):
    return event_quotas(spark, sf)


@query("src_17_budget_applied", sql=f"""WITH {QUOTAS},
placed AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, event_type FROM placed JOIN quotas ON file = event_type
WHERE quota >= n OR (i * quota) // n > ((i - 1) * quota) // n""")
def budget_applied(spark, sf):
    return K.thin_by_quota(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id", event_quotas(spark, sf))


@query("src_19_sampling_note", doubles="share_pct", sql="""
SELECT count(*) AS available, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS kept,
  count(*) FILTER (WHERE o_orderkey % 2 = 0) * 100.0 / count(*) AS share_pct FROM orders
HAVING count(*) FILTER (WHERE o_orderkey % 2 = 0) < count(*) * 0.95""")
def sampling_note(spark, sf):
    orders = table(spark, sf, "orders")
    return K.sampling_note(orders, orders.where("o_orderkey % 2 = 0"))


@query("set_01_union_by_name", sql="""
SELECT 'customer' AS kind, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def union_by_name(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"))
    return S.stack(a, b)


@query("src_15_stack_same_shape", sql="""
SELECT 'prices' AS table_name, count(*) AS rows FROM (SELECT o_orderkey FROM orders UNION ALL SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'prices__2', count(*) FROM nation""")
def same_shape(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.lit("a").alias("region"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("price"), F.lit("b").alias("region"), F.col("l_tax").alias("tax"))
    merged = S.merge_tables({"2020/prices": a, "2021/prices": b, "other/prices": table(spark, sf, "nation")})
    out = None
    for name, df in merged.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("set_03_difference", sql="SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1995-09-01')")
def difference(spark, sf):
    return S.difference(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_orderdate < DATE '1995-09-01'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


EVENTS6 = """e AS (SELECT CAST(ts AS DATE) AS date, event_type || ' of user ' || user_id AS title, 0 AS o FROM events
  UNION ALL SELECT CAST(ts AS DATE), upper(event_type) || ' OF USER ' || user_id, 1 FROM events WHERE user_id % 2 = 0)"""


@query("set_06_merge_events", sql="WITH " + EVENTS6 + """
SELECT date, title FROM e QUALIFY row_number() OVER (PARTITION BY date_trunc('month', date), left(lower(trim(title)), 40) ORDER BY o, date, title) = 1""")
def merge_events(spark, sf):
    events = table(spark, sf, "events")
    named = events.select(F.to_date("ts").alias("date"), F.concat("event_type", F.lit(" of user "), F.col("user_id").cast("string")).alias("title"), "user_id")
    second = named.where("user_id % 2 = 0").select("date", F.upper("title").alias("title"))
    return S.merge_events(named.select("date", "title"), second)


# ---- dimension joins and report tables ---------------------------------------

@query("jn_11_dimension_default", sql="""
SELECT coalesce(label, 'Aniqlanmagan') AS market, count(*) AS n FROM orders LEFT JOIN (VALUES ('F', 'Birlamchi'), ('O', 'Ikkilamchi')) AS d(code, label)
ON o_orderstatus = code GROUP BY 1""")
def dimension(spark, sf):
    dim = spark.createDataFrame([("F", "Birlamchi"), ("O", "Ikkilamchi")], "o_orderstatus string, label string")
    return table(spark, sf, "orders").join(F.broadcast(dim), "o_orderstatus", "left") \
        .groupBy(F.coalesce("label", F.lit("Aniqlanmagan")).alias("market")).agg(F.count("*").alias("n"))


@query("jn_12_left_align", doubles="latest first", sql=WITH + """,
t AS (SELECT region, year(date) AS y, sum(price_usd) AS v FROM listings WHERE region <> 'NATION_3' OR year(date) > 1995 GROUP BY 1, 2)
SELECT a.region, a.v AS latest, b.v AS first FROM t a LEFT JOIN t b ON a.region = b.region AND b.y = 1995 WHERE a.y = 2001""", digits=2)
def left_align(spark, sf):
    t = listings(spark, sf).where("region <> 'NATION_3' OR year(date) > 1995").groupBy("region", F.year("date").alias("y")).agg(F.sum("price_usd").alias("v"))
    return t.where("y = 2001").select("region", F.col("v").alias("latest")).join(
        t.where("y = 1995").select("region", F.col("v").alias("first")), "region", "left")


@query("agg_20_first_last_seen", sql="""
SELECT user_id AS listing_id, min(CAST(ts AS DATE)) AS first_seen, max(CAST(ts AS DATE)) AS last_seen, count(DISTINCT CAST(ts AS DATE)) AS observations FROM events GROUP BY 1""")
def first_last(spark, sf):
    from plinth.streaming.snapshots import listing_history
    obs = table(spark, sf, "events").select(F.col("user_id").alias("listing_id"), F.to_date("ts").alias("captured_at"))
    return listing_history(obs)


@query("rpt_05_latest_in_force", sql="""
SELECT CAST(o_orderdate AS DATE) AS date, 'order ' || o_orderkey AS title, o_orderpriority AS category,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' END AS label, 'up' AS direction FROM orders WHERE o_orderstatus = 'O'
ORDER BY 1 DESC, 2 LIMIT 12""")
def in_force(spark, sf):
    events = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
                                               F.col("o_orderpriority").alias("category"), (F.col("o_orderstatus") == "O").alias("still_in_force"), F.lit("up").alias("direction"))
    labels = spark.createDataFrame([("1-URGENT", "Urgent"), ("2-HIGH", "High")], "category string, label string")
    return R.latest_in_force(events, labels)


@query("rpt_06_official_indicators", doubles="value", sql=WITH + """,
o AS (SELECT region AS name, CAST(year(date) AS INT) AS period, avg(price_usd) AS value FROM listings GROUP BY 1, 2)
SELECT name, max(period) AS period, 'USD' AS unit, arg_max(value, period) AS value FROM o GROUP BY 1""", digits=2)
def indicators(spark, sf):
    obs = listings(spark, sf).groupBy(F.col("region").alias("name"), F.year("date").alias("period")).agg(F.avg("price_usd").alias("value")) \
        .withColumn("unit", F.lit("USD"))
    return R.indicator_table(obs.withColumn("decimals", F.lit(6)))


@query("rpt_09_notes_tally", sql="""
SELECT event_type AS note, count(DISTINCT user_id) AS files, (SELECT count(DISTINCT user_id) FROM events) AS of_files FROM events GROUP BY 1""")
def notes(spark, sf):
    return R.notes_tally(table(spark, sf, "events").select(F.col("event_type").alias("note"), F.col("user_id").alias("file")))


@query("rpt_10_safe_change", doubles="change_pct", sql="""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE (c_acctbal / (c_custkey % 5) - 1) * 100 END AS change_pct FROM customer""")
def safe_change(spark, sf):
    from plinth.functions.numbers import pct_change
    base = F.when(F.col("c_custkey") % 7 == 0, F.lit(float("inf"))).otherwise((F.col("c_custkey") % 5).cast("double"))
    return table(spark, sf, "customer").select("c_custkey", pct_change(F.col("c_acctbal"), base).alias("change_pct"))


@query("rpt_11_ranked_rows", doubles="median", sql=WITH + """
SELECT region, property, count(*) AS listings, quantile_cont(sqm_usd, 0.5) AS median FROM listings WHERE property = 'F' GROUP BY 1, 2
HAVING count(*) >= 15 ORDER BY median DESC, region LIMIT 12""")
def ranked(spark, sf):
    from plinth.operators.cross_section import table_medians
    return R.ranked(table_medians(listings(spark, sf), ["region", "property"], "sqm_usd"), "F", top=12)


@query("fmt_numbers_and_periods", sql="""
SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, year(o_orderdate) || '-Ch' || quarter(o_orderdate) AS label,
  year(o_orderdate) || '-yil ' || ['I', 'II', 'III', 'IV'][quarter(o_orderdate)] || ' chorak' AS phrase FROM orders""")
def formats(spark, sf):
    q = table(spark, sf, "orders").select(F.trunc(F.to_date("o_orderdate"), "quarter").alias("quarter")).distinct()
    return q.select("quarter", D.quarter_label(F.col("quarter")).alias("label"), D.quarter_phrase(F.col("quarter")).alias("phrase"))
