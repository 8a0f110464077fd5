"""Marketplace adverts: nested pages to one cleaned, pooled row per advert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from plinth.functions.numbers import finite, ratio
from plinth.functions.places import UNKNOWN, canonical_district, canonical_region
from plinth.operators.order_stats import keep_first, quantiles

# Currency codes, bounds, parameter names and labels.
USD_CODES = ["UYE", "USD", "U.E.", "УЕ", "У.Е."]
UZS_CODES = ["UZS", "SUM", "СУМ", "СЎМ"]
DEFAULT_RATE = 12_650.0
AREA_BOUNDS = (10.0, 1_000.0)
RENT_BOUNDS = (10.0, 50_000.0)
SALE_BOUNDS = (1_000.0, 5_000_000.0)
ROOM_BOUNDS = (1, 15)
NUMERIC_PARAMS = {
    "total_area": "total_area", "total_living_area": "living_area", "kitchen_area": "kitchen_area",
    "number_of_rooms": "rooms", "floor": "floor", "total_floors": "total_floors", "ceiling_height": "ceiling_height",
}
LABEL_PARAMS = {
    "house_type": "building_type", "repairs": "condition", "furnished": "furnished", "layout": "layout", "wc": "bathroom",
    "comission": "agent_commission", "year_of_construction_rent": "year_built", "year_of_construction": "year_built",
}
PARAMS = ["price", *NUMERIC_PARAMS, *LABEL_PARAMS, "market", "market_type"]
RENT_MARKERS = ["year_of_construction_rent", "comission", "rent"]
RENT_WORDS = ["ijara", "arenda", "аренд", "rent", "kiraga", "ijaraga"]
FIRST_MARKET, SECOND_MARKET, NO_MARKET = "Birlamchi", "Ikkilamchi", "Aniqlanmagan"
FLAT, HOUSE = "Kvartira", "Hovli"
CATEGORIES = ["rent_apartment", "sale_apartment", "rent_house", "sale_house"]
HOUSING_FIELDS = ["id", "url", "title", "params", "location", "category", "created_time", "last_refresh_time"]


def clean_text(x) -> Column:
    """Single-spaced trimmed text, NULL when empty."""
    x = F.col(x) if isinstance(x, str) else x
    return F.nullif(F.trim(F.regexp_replace(x.cast("string"), r"\s+", " ")), F.lit(""))


def text_number(text: Column) -> Column:
    """A decimal number written with point or comma, NULL for any other text ("nan", "inf" and "1d" too)."""
    digits = "[0-9](_?[0-9])*"
    whole = text.rlike(rf"^[+-]?({digits}([.,]({digits})?)?|[.,]{digits})([eE][+-]?[0-9]+)?\z")
    return F.when(whole, finite(F.translate(text, ",_", ".").try_cast("double")))


def place_name(place: Column) -> Column:
    """Display name, else the slug in title case."""
    slug = clean_text(place["normalized_name"])
    return F.coalesce(clean_text(place["name"]), F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))))


def is_listing_feed(schema: StructType) -> bool:
    """A feed's records (bare or under ``data``) carry a params list and a location or category."""
    record = schema
    if "data" in schema.names and isinstance(schema["data"].dataType, ArrayType):
        record = schema["data"].dataType.elementType
    return isinstance(record, StructType) and "params" in record.names \
        and isinstance(record["params"].dataType, ArrayType) and ("location" in record.names or "category" in record.names)


def explode_pages(pages: DataFrame) -> DataFrame:
    """Adverts of page records and bare adverts, as one table."""
    wrapped = pages.select(F.explode("data").alias("ad")).select("ad.*") if "data" in pages.columns else None
    bare = pages.where("params IS NOT NULL").drop("data", "metadata") if "params" in pages.columns else None
    if wrapped is None or bare is None:
        return wrapped if bare is None else bare
    return wrapped.unionByName(bare, allowMissingColumns=True)


def param(key: str) -> Column:
    """Value struct of the last parameter with this key (over the column of ``with_params``)."""
    return F.get("__params", F.lit(PARAMS.index(key)))


def with_params(ads: DataFrame) -> DataFrame:
    """The value structs of the known parameters as one array, the last of each key, NULL where it is absent.

    The generator is a fence: the optimiser copies nothing over it, so the array is made once a row
    and not once for each column and again for the filter of the price.
    """
    keys, values = F.reverse("params.key"), F.reverse("params.value")
    found = [F.try_element_at("__values", F.nullif(F.array_position("__keys", k), F.lit(0)).cast("int")) for k in PARAMS]
    rows = ads.select("*", F.inline(F.array(F.struct(keys.alias("__keys"), values.alias("__values")))))
    return rows.select("*", F.explode(F.array(F.array(*found))).alias("__params")).drop("__keys", "__values")


def in_steps(rows: DataFrame, columns: dict[str, Column], most: int = 4) -> DataFrame:
    """The rows with the columns as ``__name``, made a few at a time behind a generator each.

    Spark compiles a projection to one method, and a method of more than 8,000 bytes is never
    optimised by the JVM; behind a generator it is a method of its own.
    """
    names = list(columns)
    for at in range(0, len(names), most):
        rows = rows.select("*", F.inline(F.array(F.struct(*[columns[n].alias(f"__{n}") for n in names[at:at + most]]))))
    return rows


def advert_rows(ads: DataFrame) -> DataFrame:
    """One flat row per advert with a price."""
    price = param("price")
    numbers, labels = {}, {}
    for key, name in NUMERIC_PARAMS.items():
        v = param(key)
        numbers[name] = finite(F.coalesce(v["key"], v["value"]).try_cast("double"))
    for key, name in LABEL_PARAMS.items():
        label = clean_text(param(key)["label"])
        labels[name] = F.coalesce(label, labels[name]) if name in labels else label
    market = F.coalesce(param("market"), param("market_type"))
    label, code = F.lower(market["label"]), F.lower(market["key"])
    labels["market"] = F.when((code == "primary") | label.rlike("первич|birlamchi"), FIRST_MARKET) \
        .when((code == "secondary") | label.rlike("вторич|ikkilamchi"), SECOND_MARKET).otherwise(NO_MARKET)
    place = ads.schema["location"].dataType
    places = {
        "region": place_name(F.col("location.region")), "city": place_name(F.col("location.city")),
        "district": place_name(F.col("location.district")) if "district" in place.names else F.lit(None).cast("string"),
    }
    paid = {
        "price": finite(price["value"].try_cast("double")),
        "currency": F.upper(F.trim(F.coalesce(price["currency"], F.lit("")))),
        "negotiable": F.coalesce(price["negotiable"], F.lit(False)),
    }
    rows = with_params(ads)
    for made in (paid, numbers, labels, places):
        rows = in_steps(rows, made)
        rows = rows.where("__price IS NOT NULL") if made is paid else rows
    own = {
        "listing_id": F.col("id"), "title": F.col("title"), "url": F.col("url"), "date": clean_text("created_time"),
        "region": F.col("__region"), "city": F.col("__city"),
        "seller": F.when(F.coalesce("business", F.lit(False)), "business").otherwise("private"),
    }
    rest = {n: F.col(f"__{n}") for n in (*paid, *numbers, *labels, "district")}
    return rows.select(*[c.alias(n) for n, c in {**own, **rest}.items()], *[c for c in ("collection_category",) if c in ads.columns])


def dedupe(rows: DataFrame, keys=("listing_id",), order=("date",)) -> DataFrame:
    """One row per advert id, the first by date and then by every other column."""
    order = [c for c in order if c in rows.columns] or [rows.columns[0]]
    return keep_first(rows, list(keys), order)


def listing_type(ads: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: rent or sale, from parameter names, else titles, else the dollar median.

    Decided on the whole feed.
    """
    by_param = ads.agg(F.max(F.exists("params", lambda p: F.lower(p["key"]).rlike("|".join(RENT_MARKERS)))).alias("p"))
    word = "(?U)\\b(" + "|".join(RENT_WORDS) + ")\\b"
    usd = F.col("currency").isin(USD_CODES)
    facts = rows.agg(F.max(F.lower("title").rlike(word)).alias("t"), F.count_if(usd).alias("n"))
    median = quantiles(rows.where(usd), [], {"price": {"m": .5}}).scalar()
    rent = F.coalesce(by_param.scalar(), F.lit(False)) | F.coalesce("t", F.lit(False)) | \
        F.coalesce((F.col("n") >= 30) & (median < 5000), F.lit(False))
    return facts.select(F.when(rent, "rent").otherwise("sale").alias("listing_type"))


def in_dollars(price: Column, currency: Column, rate: float) -> Column:
    """Dollar-linked codes at par, local currency at the rate, anything else NULL."""
    return F.when(currency.isin(USD_CODES), price).when(currency.isin(UZS_CODES), price / F.lit(float(rate)))


def currency_counts(rows: DataFrame) -> DataFrame:
    """How many adverts were quoted in dollars, in local currency and in neither."""
    usd, uzs = F.col("currency").isin(USD_CODES), F.col("currency").isin(UZS_CODES)
    return rows.agg(F.count_if(usd).alias("usd"), F.count_if(uzs).alias("uzs"),
                    F.count_if(~F.coalesce(usd | uzs, F.lit(False)) & F.col("price").isNotNull()).alias("other"))


def derive_and_clean(rows: DataFrame, rate: float = DEFAULT_RATE, kind: str | Column = "kind") -> DataFrame:
    """Dollar price, bounded area, rooms and price, price per m2; implausible prices are dropped.

    The price as advertised mixes currencies and does not survive.
    """
    kind = F.col(kind) if isinstance(kind, str) else kind
    area = F.col("total_area")
    out = rows.withColumn("price_usd", in_dollars(F.col("price"), F.col("currency"), rate)) \
        .withColumn("total_area", F.when(area.between(*AREA_BOUNDS), area)) \
        .withColumn("rooms", F.when(F.col("rooms").between(*ROOM_BOUNDS), F.col("rooms")))
    price = F.col("price_usd")
    ok = F.when(kind == "rent", price.between(*RENT_BOUNDS)).otherwise(price.between(*SALE_BOUNDS))
    return out.where(ok).withColumn("price_per_sqm_usd", finite(ratio("price_usd", "total_area"))).drop("price")


def second_source_rows(rows: DataFrame, source: str = "second") -> DataFrame:
    """The other site's listings in the pooled shape.

    A price per m2 needs an area and becomes a total; other bases, non-monthly rents and
    unknown currencies are dropped; "2+1" rooms count as 2.
    """
    kind = F.when(F.col("operationType") == "rent", "rent").otherwise("sale")
    area = finite(F.col("square").try_cast("double"))
    per_m2 = F.col("priceType") == "sqm"
    raw = finite(F.col("price").try_cast("double"))
    price = F.when(per_m2, raw * area).otherwise(raw)
    basis = F.col("priceType").isNull() | F.col("priceType").isin("all", "sqm")
    monthly = (kind == "sale") | F.col("pricePeriodUnit").isNull() | (F.col("pricePeriodUnit") == "month")
    currency = F.upper("priceCurrency")
    return rows.where(basis & monthly & currency.isin("USD", "UZS") & (~F.coalesce(per_m2, F.lit(False)) | (area > 0))) \
        .select(F.concat(F.lit(f"{source}:"), F.col("id").cast("string")).alias("listing_id"), kind.alias("kind"),
                F.coalesce("property", F.lit(FLAT)).alias("property"), price.alias("price"), currency.alias("currency"),
                F.col("createdAt").alias("date"), area.alias("total_area"),
                finite(F.substring_index("room", "+", 1).try_cast("double")).alias("rooms"),
                "region", "city", "district",
                F.when(F.col("isNewBuilding"), FIRST_MARKET).when(~F.col("isNewBuilding"), SECOND_MARKET)
                 .otherwise(NO_MARKET).alias("market"), F.lit(source).alias("source")).where("price IS NOT NULL")


def housing_fields(offers: DataFrame, category: str | Column) -> DataFrame:
    """Only fields about the dwelling, never contacts or photos; absent ones become NULL."""
    category = F.lit(category) if isinstance(category, str) else category
    return offers.select(*[F.col(c) if c in offers.columns else F.lit(None).cast("string").alias(c)
                           for c in HOUSING_FIELDS], category.alias("collection_category"))


def second_source_fields(raw: DataFrame, categories: dict[int, str], fields: list[str],
                         nested: dict[str, str]) -> DataFrame:
    """Whitelisted categories, sales and rents only, nested names projected, the rest dropped."""
    prop = F.try_element_at(F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]), F.col("category.id"))
    return raw.withColumn("property", prop).where(
        F.col("property").isNotNull() & F.col("operationType").isin("sale", "rent")).select(
        "property", *[F.col(f) for f in fields], *[F.col(path).alias(name) for name, path in nested.items()])


def pool_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both sources in one shape, one row per (listing_id, kind, property)."""
    tagged = first.where(F.col("collection_category").isin(CATEGORIES)) \
        .withColumn("kind", F.split_part("collection_category", F.lit("_"), F.lit(1))) \
        .withColumn("property", F.when(F.col("collection_category").endswith("apartment"), FLAT).otherwise(HOUSE)) \
        .withColumn("listing_id", F.col("listing_id").cast("string")).drop("collection_category")
    return dedupe(tagged.unionByName(second, allowMissingColumns=True), ("listing_id", "kind", "property"))


def pool(first: DataFrame, second: DataFrame, rate: float = DEFAULT_RATE) -> tuple[DataFrame, DataFrame]:
    """(pooled cleaned listings, one row with collected / kept / screened counts)."""
    both = pool_rows(first, second)
    clean = derive_and_clean(both, rate) \
        .withColumn("sqm_usd", ratio("price_usd", "total_area")) \
        .withColumn("sqm_uzs", ratio(F.col("price_usd") * float(rate), "total_area")) \
        .withColumn("region", canonical_region("region", F.col("city"))) \
        .withColumn("district", canonical_district("district")) \
        .withColumn("city", F.coalesce("city", F.lit(UNKNOWN)))
    kept = clean.agg(F.count("*")).scalar()
    counts = both.agg(F.count("*").alias("collected")).withColumn("kept", kept) \
        .withColumn("screened", F.col("collected") - F.col("kept"))
    return clean, counts
