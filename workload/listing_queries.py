"""Adverts, pooling, archive cleaning, places, cleaning and quality screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import places as PL
from plinth.operators import archive as A
from plinth.operators import clean as C
from plinth.operators import listings as L
from plinth.operators import quality as Q
from plinth.session import measured
from workload.registry import query
from workload.tables import LISTINGS, listings, table

WITH = "WITH " + LISTINGS
RATE = 12650.0
# Listings for each task that makes pages of them, or counts their ids.
PAGED_ROWS = 200_000

SOURCE_ADS = WITH + """,
src AS (SELECT *, CASE listing_id % 4 WHEN 0 THEN 'UYE' WHEN 1 THEN 'UZS' WHEN 2 THEN 'USD' ELSE 'EUR' END AS currency FROM listings),
raw AS (SELECT listing_id, 'Flat in ' || region AS title, CAST(date AS VARCHAR) AS date,
  CASE WHEN segment = 'BUILDING' THEN replace(upper(left(region, 1)) || lower(substr(region, 2)), '_', '_') ELSE region END AS region,
  macro_region AS city, CASE WHEN source = 'B' THEN 'business' ELSE 'private' END AS seller,
  CASE WHEN currency = 'UZS' THEN price_usd * 12650 ELSE price_usd END AS price, currency, source = 'A' AS negotiable,
  total_area, rooms, segment AS condition,
  CASE market WHEN 'F' THEN 'Birlamchi' WHEN 'O' THEN 'Ikkilamchi' ELSE 'Aniqlanmagan' END AS market, kind, property
  FROM src WHERE rooms <> 7)"""


def advert(at=F.col):
    """The columns of one advert of a feed, from those of a listing; one advert in seven carries no price."""
    text = lambda c: at(c).cast("string")

    def p(key, value=None, currency=None, negotiable=None, code=None, label=None):
        none = F.lit(None).cast("string")
        return F.struct(F.lit(key).alias("key"), F.struct(
            (value if value is not None else none).alias("value"), (currency if currency is not None else none).alias("currency"),
            (negotiable if negotiable is not None else F.lit(None).cast("boolean")).alias("negotiable"),
            (code if code is not None else none).alias("key"), (label if label is not None else none).alias("label")).alias("value"))

    m = at("listing_id") % 4
    currency = F.when(m == 0, "UYE").when(m == 1, "UZS").when(m == 2, "USD").otherwise("EUR")
    price = F.when(currency == "UZS", at("price_usd") * RATE).otherwise(at("price_usd"))
    params = F.array_compact(F.array(
        F.when(at("rooms") != 7, p("price", price.cast("string"), F.lower(currency), at("source") == "A")),
        p("total_area", code=text("total_area")), p("number_of_rooms", value=text("rooms")),
        p("repairs", label=F.concat(F.lit("  "), at("segment"), F.lit(" "))),
        p("market", code=F.when(at("market") == "F", "primary").when(at("market") == "O", "secondary"))))
    slug = F.lower(at("region"))
    place = F.struct(F.when(at("segment") != "BUILDING", at("region")).alias("name"), slug.alias("normalized_name"))
    return [
        at("listing_id").alias("id"), F.concat(F.lit("Flat in "), at("region")).alias("title"),
        F.lit(None).cast("string").alias("url"), F.concat(F.lit(" "), text("date")).alias("created_time"),
        (at("source") == "B").alias("business"), F.struct(F.lit(1).alias("id")).alias("category"),
        F.struct(F.struct(at("macro_region").alias("name"), F.lit(None).cast("string").alias("normalized_name")).alias("city"),
                 place.alias("region")).alias("location"), params.alias("params"), at("kind").alias("kind"), at("property").alias("property")]


def ads(spark, sf):
    """The listings as the nested adverts of a feed."""
    return listings(spark, sf).select(*advert())


@query("lst_01_advert_params", doubles="price total_area rooms", sql=SOURCE_ADS + """
SELECT listing_id, title, date, city, seller, price, currency, negotiable, total_area, rooms, condition, market FROM raw""")
def advert_params(spark, sf):
    return L.advert_rows(ads(spark, sf)).select("listing_id", "title", "date", "city", "seller", "price", "currency",
                                                "negotiable", "total_area", "rooms", "condition", "market")


@query("lst_02_place_name", sql=SOURCE_ADS + " SELECT region, city, count(*) AS n FROM raw GROUP BY 1, 2")
def place_name(spark, sf):
    return L.advert_rows(ads(spark, sf)).groupBy("region", "city").agg(F.count("*").alias("n"))


@query("lst_03_safe_text_and_float", doubles="value", sql=r"""
SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS text, TRY_CAST(split_part(text, ' ', 1) AS DOUBLE) AS value
FROM documents WHERE NOT regexp_matches(split_part(text, ' ', 1), '(?i)nan|inf|e|_')""")
def safe_text(spark, sf):
    docs = table(spark, sf, "documents")
    first = F.split_part("text", F.lit(" "), F.lit(1))
    return docs.where(~first.rlike("(?i)nan|inf|e|_")).select(
        "doc_id", L.clean_text("text").alias("text"), L.finite(first.try_cast("double")).alias("value"))


# What a number in a text is: digits (single underscores between them), a point or comma, an exponent.
FLOAT_SQL = r"""CASE WHEN regexp_full_match(word, '[+-]?([0-9](_?[0-9])*([.,]([0-9](_?[0-9])*)?)?|[.,][0-9](_?[0-9])*)([eE][+-]?[0-9]+)?')
  THEN TRY_CAST(replace(replace(word, ',', '.'), '_', '') AS DOUBLE) END"""


@query("lst_03_text_and_float_all", doubles="value", sql=rf"""
SELECT doc_id, text, CASE WHEN isfinite(number) THEN number END AS value FROM (
  SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS text, {FLOAT_SQL} AS number
  FROM (SELECT doc_id, text, split_part(text, ' ', 1) AS word FROM documents))""")
def safe_text_all(spark, sf):
    """Every document; ``lst_03_safe_text_and_float`` leaves out those whose first word has nan, inf, e or _."""
    first = F.split_part("text", F.lit(" "), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", L.clean_text("text").alias("text"), L.text_number(first).alias("value"))


@query("src_21_explode_pages", sql=SOURCE_ADS + " SELECT kind, count(*) AS adverts, count(DISTINCT listing_id) AS ids FROM src GROUP BY 1")
def explode_pages(spark, sf):
    """Odd adverts come in pages, the others bare.

    A task gathers a fixed number of listings or ids, however many there are: pages are made of flat listings and their adverts
    where the page stands, and ids leave the joins before they are counted, whose tasks held sorted rows and all their ids at once.
    """
    rows, odd = listings(spark, sf), F.col("listing_id") % 2 == 1
    tasks = table(spark, sf, "lineitem").count() // PAGED_ROWS + 1
    dealt = rows.where(odd).select(F.floor(F.col("listing_id") / 40).alias("page"), F.struct(*rows.columns).alias("row")).repartition(tasks, "page")
    pages = dealt.groupBy("page").agg(F.collect_list("row").alias("rows")).select(
        F.transform("rows", lambda r: F.struct(*advert(lambda c: r[c]))).alias("data"))
    both = pages.unionByName(rows.where(~odd).select(*advert()), allowMissingColumns=True)
    return L.explode_pages(both).repartition(tasks, "id").groupBy("kind").agg(F.count("*").alias("adverts"), F.count_distinct("id").alias("ids"))


@query("src_20_feed_detection", sql="SELECT 'adverts' AS feed, true AS is_listing_feed UNION ALL SELECT 'orders', false")
def feed_detection(spark, sf):
    verdicts = [(n, L.is_listing_feed(df.schema)) for n, df in
                (("adverts", ads(spark, sf)), ("orders", table(spark, sf, "orders")))]
    n = table(spark, sf, "region").agg(F.count("*").alias("n"))
    return n.select(F.inline(F.array(*[F.struct(F.lit(a).alias("feed"), F.lit(b).alias("is_listing_feed")) for a, b in verdicts])))


@query("src_24_housing_fields")
def housing_fields(spark, sf):
    return L.housing_fields(ads(spark, sf), F.concat(F.col("kind"), F.lit("_apartment"))).select("id", "title", "collection_category")


@query("lst_04_dedupe_keep_first", doubles="price_usd total_area", sql=WITH + """
SELECT listing_id, date, region, kind, price_usd, total_area FROM listings
QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY date, region, macro_region, segment, kind, property, market, source, rooms,
  total_area, price_usd) = 1""")
def dedupe(spark, sf):
    return L.dedupe(listings(spark, sf)).select("listing_id", "date", "region", "kind", "price_usd", "total_area")


@query("win_10_keep_last", doubles="price_usd", sql=WITH + """
SELECT region, market, max(date) AS date, max(price_usd) FILTER (WHERE date = md) AS price_usd FROM
  (SELECT *, max(date) OVER (PARTITION BY region, market) AS md FROM listings) GROUP BY 1, 2""")
def keep_last(spark, sf):
    from plinth.operators.panel import keep_last as last
    return last(listings(spark, sf), ["region", "market"], "date", "price_usd")


@query("lst_05_listing_type", sql=SOURCE_ADS + """
SELECT CASE WHEN (SELECT bool_or(regexp_matches(lower(title), '\\b(ijara|arenda|rent|kiraga|ijaraga)\\b')) FROM raw)
  OR (SELECT count(*) >= 30 AND quantile_cont(price, 0.5) < 5000 FROM raw WHERE currency IN ('USD', 'UYE')) THEN 'rent'
  ELSE 'sale' END AS listing_type""")
def listing_type(spark, sf):
    rows = ads(spark, sf)
    return L.listing_type(rows, L.advert_rows(rows))


@query("lst_06_one_currency", sql=SOURCE_ADS + """
SELECT count(*) FILTER (WHERE currency IN ('USD', 'UYE')) AS usd, count(*) FILTER (WHERE currency = 'UZS') AS uzs,
  count(*) FILTER (WHERE currency = 'EUR') AS other FROM raw""")
def one_currency(spark, sf):
    return L.currency_counts(L.advert_rows(ads(spark, sf)))


CLEANED = SOURCE_ADS + """,
conv AS (SELECT *, CASE WHEN currency IN ('USD', 'UYE') THEN price WHEN currency = 'UZS' THEN price / 12650 END AS pu FROM raw),
cleaned AS (SELECT listing_id, kind, property, region, city, market, pu AS price_usd, CASE WHEN total_area BETWEEN 10 AND 1000 THEN total_area END AS total_area,
  CASE WHEN rooms BETWEEN 1 AND 15 THEN rooms END AS rooms FROM conv
  WHERE CASE WHEN kind = 'rent' THEN pu BETWEEN 10 AND 50000 ELSE pu BETWEEN 1000 AND 5000000 END)"""


@query("lst_07_bounds", doubles="price_usd total_area rooms", sql=CLEANED + """
SELECT listing_id, kind, price_usd, total_area, rooms FROM cleaned""")
def bounds(spark, sf):
    ad = ads(spark, sf)
    return L.derive_and_clean(_kinds(ad), RATE).select("listing_id", "kind", "price_usd", "total_area", "rooms")


def _kinds(ad):
    """Advert rows with their kind and property carried through the category name."""
    rows = L.advert_rows(ad.withColumn("collection_category", F.concat(F.col("kind"), F.lit("_"), F.col("property"))))
    return rows.withColumn("kind", F.split_part("collection_category", F.lit("_"), F.lit(1))) \
               .withColumn("property", F.split_part("collection_category", F.lit("_"), F.lit(2))).drop("collection_category")


@query("lst_08_price_per_sqm", doubles="price_per_sqm_usd", sql=CLEANED + """
SELECT listing_id, kind, rooms, price_usd / total_area AS price_per_sqm_usd FROM cleaned""")
def per_sqm(spark, sf):
    return L.derive_and_clean(_kinds(ads(spark, sf)), RATE).select("listing_id", "kind", "rooms", "price_per_sqm_usd")


def second(spark, sf):
    """Part-supplier style listings of the other site, from lineitem itself."""
    k = F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_returnflag") == "R", "rent").otherwise("sale").alias("operationType"),
        F.col("l_extendedprice").alias("price"), F.when(k % 5 == 4, "eur").when(k % 2 == 0, "usd").otherwise("uzs").alias("priceCurrency"),
        F.when(k % 7 == 0, "sotka").when(k % 7 == 1, "sqm").when(k % 7 == 2, None).otherwise("all").alias("priceType"),
        F.when(k % 3 == 0, "day").otherwise("month").alias("pricePeriodUnit"), F.col("l_quantity").alias("square"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit("+1")).alias("room"),
        F.lit(None).cast("string").alias("property"), F.lit("Toshkent").alias("region"), F.lit("Ташкент").alias("city"),
        F.lit("Чиланзарский район").alias("district"), F.to_date("l_shipdate").cast("string").alias("createdAt"),
        F.when(k % 2 == 0, F.col("l_linestatus") == "F").alias("isNewBuilding"))


SECOND = """s AS (SELECT *, l_partkey AS k FROM lineitem),
second AS (SELECT 'second:' || (l_orderkey * 10 + l_linenumber) AS listing_id, CASE WHEN l_returnflag = 'R' THEN 'rent' ELSE 'sale' END AS kind,
  CASE WHEN k % 7 = 1 THEN l_extendedprice * l_quantity ELSE l_extendedprice END AS price,
  CASE WHEN k % 2 = 0 THEN 'USD' ELSE 'UZS' END AS currency, l_quantity AS total_area, CAST(l_linenumber AS DOUBLE) AS rooms,
  CASE WHEN k % 2 = 0 THEN CASE WHEN l_linestatus = 'F' THEN 'Birlamchi' ELSE 'Ikkilamchi' END ELSE 'Aniqlanmagan' END AS market
  FROM s WHERE k % 7 <> 0 AND k % 5 <> 4 AND NOT (l_returnflag = 'R' AND k % 3 = 0))"""


@query("lst_09_second_source", doubles="price total_area rooms", sql="WITH " + SECOND + " SELECT * FROM second")
def second_source(spark, sf):
    return L.second_source_rows(second(spark, sf)).select("listing_id", "kind", "price", "currency", "total_area", "rooms", "market")


@query("src_23_second_source_whitelist", sql="""
SELECT CASE l_linenumber WHEN 1 THEN 'Kvartira' ELSE 'Hovli' END AS property, count(*) AS n FROM lineitem
WHERE l_linenumber IN (1, 2, 3) AND l_returnflag <> 'N' GROUP BY 1""")
def whitelist(spark, sf):
    raw = second(spark, sf).withColumn("n", F.col("id") % 10).withColumn(
        "operationType", F.when(F.col("id").isNull(), None).otherwise(F.col("operationType")))
    line = table(spark, sf, "lineitem").select(
        F.struct(F.col("l_linenumber").alias("id")).alias("category"),
        F.when(F.col("l_returnflag") == "R", "rent").when(F.col("l_returnflag") == "A", "sale").otherwise("exchange").alias("operationType"),
        F.struct(F.struct(F.col("l_shipdate").cast("string").alias("uz")).alias("name")).alias("region"), F.lit("x").alias("phone"))
    del raw
    return L.second_source_fields(line, {1: "Kvartira", 2: "Hovli", 3: "Hovli"}, ["operationType"], {"region": "region.name.uz"}) \
        .groupBy("property").agg(F.count("*").alias("n"))


@query("lst_10_pool_sources", sql=CLEANED.replace("WITH ", "WITH " + SECOND + ", ", 1) + """,
firsts AS (SELECT DISTINCT listing_id, kind, property FROM (SELECT listing_id, kind, property, price, currency FROM raw)),
two AS (SELECT listing_id, kind, CASE WHEN currency = 'UZS' THEN price / 12650 ELSE price END AS pu FROM second)
SELECT 'first' AS source, count(*) AS n FROM firsts UNION ALL SELECT 'second', count(DISTINCT (listing_id, kind)) FROM two""")
def pool_counts(spark, sf):
    return L.pool_rows(*_pooled(spark, sf)).groupBy("source").agg(F.count("*").alias("n"))


def _pooled(spark, sf):
    ad = ads(spark, sf)
    first = L.advert_rows(ad.withColumn("collection_category", F.concat(F.col("kind"), F.when(
        F.col("property") == "F", "_apartment").otherwise("_house")))).withColumn("source", F.lit("first"))
    return first, L.second_source_rows(second(spark, sf))


def pooled_listings(spark, sf):
    first, other = _pooled(spark, sf)
    return L.pool(first.withColumn("district", F.lit("Чиланзарский район")), other, RATE)


@query("lst_10_pooled_counts")
def pooled_kept(spark, sf):
    return pooled_listings(spark, sf)[1]


@query("lst_10_pooled_listings")
def pooled(spark, sf):
    return pooled_listings(spark, sf)[0].groupBy("source", "kind", "property", "region", "district").agg(
        F.count("*").alias("n"), F.avg("sqm_usd").alias("sqm_usd"))


# ---- archive ----------------------------------------------------------------

def raw_archive(spark, sf):
    """Archive rows as they arrive: quoted text, month-year strings, three market names."""
    rows = listings(spark, sf)
    n = F.col("listing_id") % 5
    return rows.select(
        F.concat(F.lit("'"), F.date_format("date", "MM-yyyy"), F.lit("'")).alias("month_and_year"),
        F.when(n == 0, "nan").otherwise(F.concat(F.lit('"'), F.col("region"), F.lit('"'))).alias("state"),
        F.col("price_usd").cast("string").alias("price1"),
        F.when(n == 1, "'у.е.'").when(n == 2, "сум").when(n == 3, "none").otherwise("USD ").alias("currency"),
        F.col("total_area").alias("Общая площадь:"),
        F.when(F.col("market") == "F", "Новостройки").when(F.col("market") == "O", "Вторичный рынок").otherwise("?").alias("Тип жилья:"))


@query("arc_01_archive_clean", doubles="price area usd_sqm", sql=WITH + """
SELECT CAST(date_trunc('month', date) AS DATE) AS month, CASE WHEN listing_id % 5 = 0 THEN 'Ko''rsatilmagan' ELSE region END AS region_uz,
  CASE market WHEN 'F' THEN 'Birlamchi' WHEN 'O' THEN 'Ikkilamchi' ELSE 'Aniqlanmagan' END AS market, 'Ko''rsatilmagan' AS district,
  price_usd AS price, total_area AS area, price_usd / total_area AS usd_sqm FROM listings
WHERE listing_id % 5 <> 2 AND price_usd BETWEEN 1000 AND 5000000 AND total_area BETWEEN 10 AND 1000""")
def archive_clean(spark, sf):
    return A.clean_archive(A.select_archive(raw_archive(spark, sf)))


# ---- places -----------------------------------------------------------------

SPELLINGS = ["Ташкентская область", "Tashkent oblast", "Toshkent shahri", "г. Ташкент город", "Farg‘ona viloyati", "Ферганская область",
             "Qoraqalpogʻiston Respublikasi", "Самаркандская область", "Buxoro", "Nowhere land", "  ", "nan"]
SPELLED = ["Toshkent Viloyati", "Toshkent Viloyati", "Toshkent shahri", "г. Ташкент город", "Farg'ona Viloyati", "Farg'ona Viloyati",
           "Qoraqalpogʻiston Respublikasi", "Samarqand Viloyati", "Buxoro Viloyati", "Nowhere land", "Ko'rsatilmagan", "Ko'rsatilmagan"]
quoted = lambda items: "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in items) + "]"


def spelled(spark, sf, spellings, city=None):
    arr = F.array(*[F.lit(s) for s in spellings])
    return table(spark, sf, "customer").withColumn("name", F.element_at(arr, (F.col("c_custkey") % len(spellings) + 1).cast("int")))


@query("plc_01_canonical_region", sql=f"""
SELECT {quoted(SPELLED)}[CAST(c_custkey % {len(SPELLED)} + 1 AS INT)] AS region, count(*) AS n FROM customer GROUP BY 1""")
def canonical_region(spark, sf):
    return spelled(spark, sf, SPELLINGS).groupBy(PL.canonical_region("name").alias("region")).agg(F.count("*").alias("n"))


DISTRICTS = ["Ташкент, Мирзо-Улугбекский район", "Ташкент, Чиланзарский район", "Юнусабадский район", "Mirzo Ulug`bek tumani", "Yakkasaroy tumani",
             "Самарканд, Чиланзарский район", "Sergeli", "somewhere", ""]
DISTRICTS_OUT = ["Mirzo Ulug'bek", "Chilonzor", "Yunusobod", "Mirzo Ulug'bek", "Yakkasaroy", "Ko'rsatilmagan", "Sergeli", "Ko'rsatilmagan", "Ko'rsatilmagan"]


@query("plc_02_canonical_district", sql=f"""
SELECT {quoted(DISTRICTS_OUT)}[CAST(c_custkey % {len(DISTRICTS)} + 1 AS INT)] AS district, count(*) AS n FROM customer GROUP BY 1""")
def canonical_district(spark, sf):
    return spelled(spark, sf, DISTRICTS).groupBy(PL.canonical_district("name").alias("district")).agg(F.count("*").alias("n"))


ORDER_SQL = quoted(PL.REGION_ORDER)


@query("plc_03_label_and_order", sql=f"""
WITH r AS (SELECT {quoted(SPELLED)}[CAST(c_custkey % {len(SPELLED)} + 1 AS INT)] AS region, count(*) AS n FROM customer GROUP BY 1)
SELECT region, n, CASE region WHEN 'Toshkent Viloyati' THEN 'Toshkent viloyati' WHEN 'Qoraqalpogʻiston Respublikasi' THEN 'Qoraqalpog''iston'
  ELSE regexp_replace(region, ' Viloyati$', '') END AS label, list_position({ORDER_SQL}, region) AS ord FROM r""")
def labels(spark, sf):
    rows = spelled(spark, sf, SPELLINGS).groupBy(PL.canonical_region("name").alias("region")).agg(F.count("*").alias("n"))
    return rows.withColumn("label", PL.region_label("region")).withColumn("ord", PL.region_position("region"))


@query("top_07_fixed_order", sql=f"""
WITH r AS (SELECT DISTINCT {quoted(SPELLED)}[CAST(c_custkey % {len(SPELLED)} + 1 AS INT)] AS region FROM customer)
SELECT region, row_number() OVER (ORDER BY list_position({ORDER_SQL}, region) NULLS LAST, region) AS place FROM r""")
def fixed_order(spark, sf):
    from plinth.operators.topk import fixed_order as order
    return order(spelled(spark, sf, SPELLINGS).select(PL.canonical_region("name").alias("region")).distinct(), "region")


# ---- cleaning ---------------------------------------------------------------

@query("cln_01_safe_names", sql="SELECT 'o_orderkey' AS column_name, count(*) AS n FROM orders UNION ALL SELECT 'цена_за_м_2', count(*) FROM orders")
def safe_names(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias(" O_OrderKey "), F.col("o_totalprice").alias("Цена за м²"))
    named = C.safe_columns(df.withColumnRenamed("Цена за м²", "Цена за м-2"))
    counts = named.agg(*[F.count(f"`{c}`").alias(c) for c in named.columns])
    return counts.unpivot([], named.columns, "column_name", "n")


@query("cln_02_drop_empty", sql="""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders WHERE o_orderkey % 3 <> 0""")
def drop_empty(spark, sf):
    df = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("o_orderkey"),
        F.when((F.col("o_orderkey") % 3 != 0) & (F.col("o_orderkey") % 2 == 0), F.col("o_orderstatus")).alias("status"),
        F.lit(None).cast("string").alias("nothing"))
    return C.drop_empty(df)


@query("cln_03_explode_parallel_arrays", doubles="price", sql="""
SELECT o_custkey, o_orderkey AS keys, o_totalprice AS price FROM orders""")
def explode_parallel(spark, sf):
    pair = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice")))
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(pair.alias("p"))
    g = g.select("o_custkey", F.col("p.o_orderkey").alias("keys"), F.col("p.o_totalprice").alias("price"))
    return C.explode_parallel_arrays(g)


@query("cln_04_containers_to_json", sql="""
SELECT event_id, CAST(json_object('k', CAST(json_extract(props, '$.k') AS BIGINT)) AS VARCHAR) AS props FROM events""")
def containers(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.from_json("props", "k BIGINT").alias("props"))
    return C.containers_to_json(df)


@query("cln_05_numeric_text", doubles="price rate", sql="SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_discount * 100 AS rate, l_returnflag FROM lineitem")
def numeric_text(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("$"), F.translate(F.format_number("l_extendedprice", 2), ",.", " ,")).alias("price"),
        F.concat((F.col("l_discount") * 100).cast("string"), F.lit("%")).alias("rate"), "l_returnflag")
    return C.coerce_numeric_text(df)


# ---- quality ----------------------------------------------------------------

QA = WITH + """,
base AS (SELECT *, segment AS district, round_even(total_area, 0) AS ak, round_even(price_usd / 100, 0) * 100 AS pk,
  region <> 'NATION_7' AS place_ok FROM listings),
grp AS (SELECT kind, property, region, district, rooms, ak, pk, count(*) AS copies, count(DISTINCT source) AS s FROM base
  GROUP BY 1, 2, 3, 4, 5, 6, 7),
tagged AS (SELECT b.*, copies, s, row_number() OVER (PARTITION BY b.kind, b.property, b.region, b.district, b.rooms, b.ak, b.pk
  ORDER BY b.source, date, listing_id, macro_region, market, b.place_ok, price_usd, segment, sqm_usd, total_area) AS rn
  FROM base b JOIN grp g ON b.kind = g.kind AND b.property = g.property AND b.region = g.region AND b.district = g.district
  AND b.rooms = g.rooms AND b.ak = g.ak AND b.pk = g.pk),
kept AS (SELECT * FROM tagged WHERE s < 2 OR rn = 1)"""


def qa_rows(spark, sf):
    return listings(spark, sf).withColumn("district", F.col("segment"))


@query("qa_01_unknown_place", sql=QA + " SELECT place_ok, count(*) AS n FROM base GROUP BY 1")
def unknown_place(spark, sf):
    return qa_rows(spark, sf).groupBy((F.col("region") != "NATION_7").alias("place_ok")).agg(F.count("*").alias("n"))


@query("qa_02_cross_source_duplicates", doubles="price_usd total_area", sql=QA + """
SELECT listing_id, source, kind, region, price_usd, total_area FROM kept""")
def cross_source(spark, sf):
    rows = measured(Q.with_duplicate_keys(qa_rows(spark, sf)))
    return Q.drop_cross_source(rows, measured(Q.duplicate_groups(rows))).select("listing_id", "source", "kind", "region", "price_usd", "total_area")


@query("qa_03_same_source_repeats", sql=QA + """
SELECT kind, property, region, district, rooms, ak AS area_key, pk AS price_key, source, count(*) AS n FROM tagged WHERE s < 2
GROUP BY 1, 2, 3, 4, 5, 6, 7, 8 HAVING count(*) > 1""")
def repeats(spark, sf):
    rows = Q.with_duplicate_keys(qa_rows(spark, sf))
    return Q.same_source_repeats(rows, Q.cross_source_groups(rows))


@query("qa_04_rooms_screen", sql=WITH + """
SELECT rooms * 2.5 AS rooms, rooms * 2.5 < 1 OR rooms * 2.5 > 12 OR (rooms * 2.5) % 1 <> 0 AS bad, count(*) AS n FROM listings GROUP BY 1, 2""")
def rooms_screen(spark, sf):
    rows = qa_rows(spark, sf).withColumn("rooms", F.col("rooms") * 2.5)
    return rows.groupBy("rooms", Q.bad_rooms().alias("bad")).agg(F.count("*").alias("n"))


@query("qa_05_price_band", sql=WITH + """
SELECT kind, CASE WHEN kind = 'sale' THEN sqm_usd NOT BETWEEN 80 AND 20000 ELSE sqm_usd NOT BETWEEN 0.3 AND 200 END AS implausible,
  count(*) AS n FROM listings GROUP BY 1, 2""")
def price_band(spark, sf):
    return qa_rows(spark, sf).groupBy("kind", Q.implausible_price().alias("implausible")).agg(F.count("*").alias("n"))


MAD = WITH + """,
lg AS (SELECT kind, property, ln(greatest(sqm_usd, 1e-6)) AS lx FROM listings WHERE sqm_usd IS NOT NULL),
c AS (SELECT kind, property, quantile_cont(lx, 0.5) AS centre FROM lg GROUP BY 1, 2 HAVING count(*) >= 40),
bounds AS (SELECT kind, property, centre, quantile_cont(abs(lx - centre), 0.5) AS spread FROM lg JOIN c USING (kind, property) GROUP BY 1, 2, 3)"""


@query("qa_06_log_mad_outliers", doubles="centre spread", sql=MAD + """
SELECT kind, property, centre, spread, count(*) AS n, count(*) FILTER (WHERE abs(lx - centre) > 4 * 1.4826 * spread) AS outliers
FROM lg JOIN bounds USING (kind, property) GROUP BY 1, 2, 3, 4""")
def mad(spark, sf):
    rows = measured(qa_rows(spark, sf).select("kind", "property", "sqm_usd"))
    bounds = Q.log_mad_bounds(rows)
    flagged = Q.with_outlier_flag(rows, bounds).groupBy("kind", "property").agg(
        F.count("*").alias("n"), F.count_if("outlier").alias("outliers"))
    return flagged.join(bounds.select("kind", "property", "centre", "spread"), ["kind", "property"])


@query("qa_07_yield_band", sql=WITH + """,
sides AS (SELECT region, property, rooms, kind, count(*) AS n, quantile_cont(sqm_usd, 0.5) AS m FROM listings GROUP BY 1, 2, 3, 4 HAVING count(*) >= 15),
y AS (SELECT region, 12 * r.m / s.m AS y FROM (SELECT * FROM sides WHERE kind = 'rent') r JOIN (SELECT * FROM sides WHERE kind = 'sale') s USING (region, property, rooms))
SELECT region, y BETWEEN 1 AND 25 AS plausible, count(*) AS n FROM y GROUP BY 1, 2""")
def yield_band(spark, sf):
    from plinth.operators.cross_section import rental_yield
    y = rental_yield(listings(spark, sf), ["region", "property", "rooms"]).withColumn("yield_pct", F.col("yield_pct") / 100)
    return Q.screen_yields(y).groupBy("region", "plausible").agg(F.count("*").alias("n"))


@query("qa_08_audit_table", sql=QA + """,
imp AS (SELECT *, CASE WHEN kind = 'sale' THEN sqm_usd NOT BETWEEN 80 AND 20000 ELSE sqm_usd NOT BETWEEN 300 AND 20000 END AS implausible FROM kept),
lg AS (SELECT kind, property, ln(greatest(sqm_usd, 1e-6)) AS lx FROM kept),
c AS (SELECT kind, property, quantile_cont(lx, 0.5) AS centre FROM lg GROUP BY 1, 2 HAVING count(*) >= 40),
bounds AS (SELECT kind, property, centre, quantile_cont(abs(lx - centre), 0.5) AS spread FROM lg JOIN c USING (kind, property) GROUP BY 1, 2, 3),
fl AS (SELECT i.*, coalesce(abs(ln(greatest(sqm_usd, 1e-6)) - centre) > 4 * 1.4826 * spread, false) AND NOT implausible AS outlier
  FROM imp i LEFT JOIN bounds b ON i.kind = b.kind AND i.property = b.property)
SELECT 'place' AS code, count(*) FILTER (WHERE NOT place_ok) AS affected, 'left out of regional tables' AS action,
  CASE WHEN count(*) FILTER (WHERE NOT place_ok) > 0.1 * count(*) THEN 'warn' ELSE 'info' END AS severity FROM base
UNION ALL SELECT 'cross_source', count(*), 'counted once', 'info' FROM tagged WHERE s > 1 AND rn > 1
UNION ALL SELECT 'repeat', CAST(coalesce(sum(n - 1), 0) AS BIGINT), 'kept in counts', 'info' FROM
  (SELECT count(*) AS n FROM tagged WHERE s < 2 GROUP BY kind, property, region, district, rooms, ak, pk, source)
UNION ALL SELECT 'rooms', count(*) FILTER (WHERE rooms < 1 OR rooms > 12), 'rooms emptied', 'info' FROM kept
UNION ALL SELECT 'classification', count(*) FILTER (WHERE implausible), 'price per m2 emptied',
  CASE WHEN count(*) FILTER (WHERE implausible) > 0.05 * count(*) THEN 'warn' ELSE 'info' END FROM fl
UNION ALL SELECT 'outlier', count(*) FILTER (WHERE outlier), 'price per m2 emptied', 'info' FROM fl""")
def audit(spark, sf):
    return Q.audit(qa_rows(spark, sf), known=F.col("region") != "NATION_7", rent=(300.0, 20000.0))[1]
