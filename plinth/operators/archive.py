"""The archive of individual adverts and the aggregates published from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.numbers import finite, ratio
from plinth.functions.places import UNKNOWN, canonical_district
from plinth.operators.order_stats import RankDirectory, join_on, keep_first, summarise

# Source column -> name here, codes, bounds and market names.
ARCHIVE_COLUMNS = {
    "month_and_year": "month",
    "state": "region_uz",
    "price1": "price",
    "currency": "currency",
    "Общая площадь:": "area",
    "Тип жилья:": "market_ru",
    "location_1": "location",
}
OPTIONAL_COLUMNS = {"location_1"}
ARCHIVE_USD = ["у.е.", "уе", "y.e.", "u.e.", "usd", "$"]
ARCHIVE_UZS = ["сум", "so'm", "som", "uzs"]
PRICE_BOUNDS = (1_000, 5_000_000)
AREA_BOUNDS = (10, 1_000)
MARKET_NAMES = {
    "Вторичный рынок": "Ikkilamchi",
    "Новостройки": "Birlamchi",
    "От застройщика": "Birlamchi",
}
NO_MARKET = "Aniqlanmagan"

TABLE_KEYS = {
    "monthly": ["month", "region_uz", "market"],
    "quarterly": ["quarter", "region_uz", "market"],
    "quarterly_district": ["quarter", "district", "market"],
}


def select_archive(raw: DataFrame) -> DataFrame:
    """Only the mapped columns; a missing required one is an error, an optional one NULL."""
    missing = set(ARCHIVE_COLUMNS) - set(raw.columns) - OPTIONAL_COLUMNS
    if missing:
        raise ValueError(f"archive columns not found: {sorted(missing)}")
    return raw.select(*[
        (F.col(f"`{name}`") if name in raw.columns else F.lit(None).cast("string")).alias(to)
        for name, to in ARCHIVE_COLUMNS.items()
    ])


def unquoted(x) -> Column:
    """Trimmed text without surrounding quotes; 'nan', 'none' and '' are NULL."""
    x = F.col(x) if isinstance(x, str) else x
    text = F.trim(F.regexp_replace(F.trim(x.cast("string")), r"^['\"]+|['\"]+$", ""))
    return F.when(~text.isin("nan", "none", "None", ""), text)


def clean_archive(rows: DataFrame) -> DataFrame:
    """Dollar-quoted adverts inside the bounds, with market, place, month and price per m2."""
    currency = F.lower(unquoted("currency"))
    price, area = finite(F.col("price").try_cast("double")), finite(F.col("area").try_cast("double"))
    market = F.create_map(*[F.lit(v) for pair in MARKET_NAMES.items() for v in pair])
    month = F.try_to_timestamp(F.concat(F.lit("01-"), unquoted("month")), F.lit("dd-MM-yyyy")).cast("date")
    return (
        rows.where(currency.isin(ARCHIVE_USD) | currency.isNull())
        .select(
            month.alias("month"),
            F.coalesce(unquoted("region_uz"), F.lit(UNKNOWN)).alias("region_uz"),
            F.coalesce(F.try_element_at(market, unquoted("market_ru")), F.lit(NO_MARKET)).alias("market"),
            canonical_district(unquoted("location")).alias("district"),
            price.alias("price"), area.alias("area"), ratio(price, area).alias("usd_sqm"))
        .where(F.col("price").between(*PRICE_BOUNDS) & F.col("area").between(*AREA_BOUNDS)
               & F.col("month").isNotNull())
    )


def aggregate_archive(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Listings, distinct months and medians per group, always over the adverts themselves."""
    rows = rows.withColumn("quarter", F.trunc("month", "quarter"))
    return summarise(
        rows, keys, [F.count("*").alias("listings"), F.count_distinct("month").alias("months")],
        {"usd_sqm": {"median_usd_sqm": .5}, "price": {"median_usd": .5}})


def published_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The three groupings of the same adverts; districts leave unknown places out.

    One directory by month, region, district and market serves all three.
    """
    rows = rows.withColumn("quarter", F.trunc("month", "quarter"))
    wanted = {"usd_sqm": {"median_usd_sqm": .5}, "price": {"median_usd": .5}}
    directory = RankDirectory(rows, ["month", "quarter", "region_uz", "district", "market"], list(wanted))
    groupings = [(keys, F.col("district") != UNKNOWN if "district" in keys else None) for keys in TABLE_KEYS.values()]
    out = {}
    for (name, keys), (_, where), medians in zip(TABLE_KEYS.items(), groupings, directory.ranks(groupings, wanted)):
        counts = directory.groups(where).groupBy(*keys).agg(F.sum("__n").alias("listings"), F.count_distinct("month").alias("months"))
        out[name] = join_on(counts, medians, keys, "left")
    return out


def combine_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, from the part with the larger sample: medians are never averaged."""
    return keep_first(parts.withColumn("__o", -F.col("listings")), keys, ["__o"]).drop("__o")


def overlapping_keys(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The periods found in more than one part (reported, not merged)."""
    return parts.groupBy(*keys).agg(F.count("*").alias("parts")).where("parts > 1") \
        .groupBy(keys[0]).agg(F.count("*").alias("groups"))


def live_month(listings: DataFrame, collected_at, kind: str = "sale", prop: str | None = None,
               region: str = "region_uz") -> DataFrame:
    """Apartment sales of a snapshot as one month of the archive series."""
    rows = listings.where((F.col("kind") == kind) & F.col("sqm_usd").isNotNull())
    if prop is not None:
        rows = rows.where(F.col("property") == prop)
    out = summarise(rows, [region, "market"], [F.count("*").alias("listings")],
                    {"sqm_usd": {"median_usd_sqm": .5}, "price_usd": {"median_usd": .5}})
    return out.select(F.trunc(F.lit(collected_at).cast("date"), "month").alias("month"),
                      F.col(region).alias("region_uz"), "market", "listings", "median_usd_sqm", "median_usd")


def national(series: DataFrame, period: str) -> DataFrame:
    """Listing-weighted mean of medians per period."""
    return series.groupBy(period).agg(
        F.sum("listings").alias("listings"),
        ratio(F.sum(F.col("median_usd_sqm") * F.col("listings")), F.sum("listings")).alias("median_usd_sqm"))
