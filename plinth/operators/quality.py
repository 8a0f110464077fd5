"""Data-quality screens over pooled listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.places import is_known_region
from plinth.operators.order_stats import join_on, quantiles, summarise
from plinth.session import measured

# Bands and limits that are part of the results.
SALE_BAND = (80.0, 20_000.0)
RENT_BAND = (0.3, 200.0)
MAX_ROOMS = 12
MAD_LIMIT, MIN_MAD_GROUP, MAD_SCALE = 4.0, 40, 1.4826
YIELD_BAND = (1.0, 25.0)
DUPLICATE_KEYS = ["kind", "property", "region", "district", "rooms", "area_key", "price_key"]


def with_duplicate_keys(df: DataFrame) -> DataFrame:
    """Area to the square metre and price to the hundred, both rounded half-even."""
    return df.withColumns({"area_key": F.bround("total_area", 0), "price_key": F.bround("price_usd", -2)})


def _priced(df: DataFrame) -> DataFrame:
    return df.where("area_key IS NOT NULL AND price_key IS NOT NULL")


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Every group with its first row, ``copies``, ``sourced`` (rows that name a source) and ``crossed`` (two sources or more).

    One aggregate over the duplicate keys: copies collapse before they are shuffled.
    """
    rest = sorted(c for c in df.columns if c not in DUPLICATE_KEYS and c != "source")
    groups = _priced(df).groupBy(*DUPLICATE_KEYS).agg(
        F.count("*").alias("copies"), F.count("source").alias("sourced"), F.min("source").alias("a"), F.max("source").alias("b"),
        F.min(F.struct("source", *rest)).alias("first"))
    return groups.select(*DUPLICATE_KEYS, "copies", "sourced", F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("crossed"), "first")


def cross_source_groups(df: DataFrame) -> DataFrame:
    """Groups of one dwelling advertised in more than one source."""
    return duplicate_groups(df).where("crossed").select(*DUPLICATE_KEYS, "copies")


def drop_cross_source(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Every group found in two sources keeps only its first row; ``groups`` are those of :func:`duplicate_groups`.

    Rows are looked up only for groups repeated within one source; all others have their row at hand.
    """
    alone = groups.where("crossed OR copies = 1").select(*DUPLICATE_KEYS, "first.*").select(*df.columns)
    again = join_on(df, groups.where("NOT crossed AND copies > 1").select(*DUPLICATE_KEYS), DUPLICATE_KEYS, "left_semi")
    return alone.unionByName(again).unionByName(df.where("area_key IS NULL OR price_key IS NULL"))


def same_source_repeats(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Offers repeated inside one source (counted, not dropped)."""
    counts = _priced(df).groupBy(*DUPLICATE_KEYS, "source").agg(F.count("*").alias("n")).where("n > 1")
    return join_on(counts, groups.select(*DUPLICATE_KEYS), DUPLICATE_KEYS, "left_anti")


def bad_rooms(rooms: str = "rooms") -> Column:
    r = F.col(rooms)
    return r.isNotNull() & ((r < 1) | (r > MAX_ROOMS) | (r % 1 != 0))


def implausible_price(value: str = "sqm_usd", sale=SALE_BAND, rent=RENT_BAND) -> Column:
    v = F.col(value)
    out = ((F.col("kind") == "sale") & ~v.between(*sale)) | ((F.col("kind") == "rent") & ~v.between(*rent))
    return F.coalesce(out, F.lit(False))


def log_mad_bounds(df: DataFrame, value: str = "sqm_usd", keys: Sequence[str] = ("kind", "property")) -> DataFrame:
    """(keys, centre, spread, n): median and median absolute deviation of the logarithm.

    Reads its rows four times: pass a table, not a plan of joins.
    """
    keys = list(keys)
    logged = df.where(F.col(value).isNotNull()).select(*keys, F.ln(F.greatest(F.col(value), F.lit(1e-6))).alias("lx"))
    centre = summarise(logged, keys, [F.count("*").alias("n")], {"lx": {"centre": .5}})
    centre = measured(centre.where((F.col("n") >= MIN_MAD_GROUP) & F.col("centre").isNotNull()).select(*keys, "centre", "n"))
    off = join_on(logged, centre, keys, "inner").select(*keys, F.abs(F.col("lx") - F.col("centre")).alias("off"))
    return measured(join_on(centre, quantiles(off, keys, {"off": {"spread": .5}}), keys, "inner").where("spread > 0"))


def with_outlier_flag(df: DataFrame, bounds: DataFrame, value: str = "sqm_usd",
                      keys: Sequence[str] = ("kind", "property")) -> DataFrame:
    far = F.abs(F.ln(F.greatest(F.col(value), F.lit(1e-6))) - F.col("centre")) > MAD_LIMIT * F.col("spread") * MAD_SCALE
    return join_on(df, bounds.select(*keys, "centre", "spread"), list(keys), "left") \
        .withColumn("outlier", F.coalesce(far, F.lit(False))).drop("centre", "spread")


def screen_yields(df: DataFrame, value: str = "yield_pct") -> DataFrame:
    """Yields with ``plausible`` saying whether they lie in the band."""
    return df.withColumn("plausible", F.coalesce(F.col(value).between(*YIELD_BAND), F.lit(False)))


def audit(df: DataFrame, screened: int = 0, known: Column | None = None, sale=SALE_BAND, rent=RENT_BAND,
          extra: Sequence[tuple[str, Column, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """(cleaned listings, findings): every screen with its count, its action and its severity.

    ``extra`` adds screens as (code, predicate, action) which are counted on the cleaned rows.
    """
    known = is_known_region("region") if known is None else known
    rows = measured(with_duplicate_keys(df.withColumn("place_ok", known)))
    groups = measured(duplicate_groups(rows))
    kept = drop_cross_source(rows, groups)
    # What the counts and the bounds read, five times: the columns they need, written once.
    counted = measured(kept if extra else kept.select("kind", "property", "rooms", "sqm_usd"))
    bounds = log_mad_bounds(counted)

    def flags(df: DataFrame) -> DataFrame:
        df = df.withColumn("bad_rooms", bad_rooms()).withColumn("implausible", implausible_price(sale=sale, rent=rent))
        return with_outlier_flag(df, bounds).withColumn("outlier", F.col("outlier") & ~F.col("implausible"))

    hide = F.col("implausible") | F.col("outlier")
    clean = flags(kept).withColumn("rooms", F.when(~F.col("bad_rooms"), F.col("rooms"))) \
        .withColumn("sqm_usd", F.when(~hide, F.col("sqm_usd")))
    if "sqm_uzs" in df.columns:
        clean = clean.withColumn("sqm_uzs", F.when(~hide, F.col("sqm_uzs")))

    def finding(source: DataFrame, code: str, count: Column, action: str, share: float | None = None) -> DataFrame:
        warn = (count > share * F.count("*")) if share else F.lit(False)
        return source.agg(F.lit(code).alias("code"), F.coalesce(count, F.lit(0)).cast("bigint").alias("affected"),
                          F.lit(action).alias("action"),
                          F.when(F.coalesce(warn, F.lit(False)), "warn").otherwise("info").alias("severity"))

    counts = flags(counted).agg(
        F.count("*").alias("n"), F.count_if("bad_rooms").alias("rooms"), F.count_if("implausible").alias("classification"),
        F.count_if("outlier").alias("outlier"),
        *[F.count_if(pred).alias(f"x_{code}") for code, pred, _ in extra])
    entries = [("rooms", "rooms", "rooms emptied", None), ("classification", "classification", "price per m2 emptied", 0.05),
               ("outlier", "outlier", "price per m2 emptied", None)]
    entries += [(code, f"x_{code}", action, None) for code, _, action in extra]
    per_row = counts.select(F.inline(F.array(*[
        F.struct(F.lit(code).alias("code"), F.col(col).alias("affected"), F.lit(action).alias("action"),
                 F.when(F.lit(share is not None) & (F.col(col) > F.lit(share or 0.0) * F.greatest("n", F.lit(1))), "warn")
                  .otherwise("info").alias("severity"))
        for code, col, action, share in entries])))
    # Offers repeated inside one source: the groups that are in no second one, rows without a source apart.
    again = F.greatest(F.col("sourced") - 1, F.lit(0)) + F.greatest(F.col("copies") - F.col("sourced") - 1, F.lit(0))
    findings = finding(rows, "place", F.count_if(~F.col("place_ok")), "left out of regional tables", 0.1) \
        .unionByName(finding(groups.where("crossed"), "cross_source", F.sum(F.col("copies") - 1), "counted once")) \
        .unionByName(finding(groups.where("NOT crossed"), "repeat", F.sum(again), "kept in counts")) \
        .unionByName(per_row)
    if screened:
        findings = findings.unionByName(finding(groups.limit(0), "screened", F.lit(screened), "excluded upstream"))
    return clean.drop("area_key", "price_key", "bad_rooms", "implausible", "outlier"), findings
