"""Cross-section of listings: distributions, group tables, contribution, mix.

Counts and means are pre-aggregated map-side; medians come from
:mod:`plinth.operators.order_stats`, so one dominant region costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.numbers import finite, pct_change, ratio
from plinth.operators.order_stats import RankDirectory, join_on, quantiles, summarise, value_cell  # noqa: F401
from plinth.session import measured

# Thresholds that are part of the results.
MIN_GROUP_SAMPLE = 30
MIN_CATEGORY = 25
MIN_TABLE = 15
MIN_PRICES = 20
MIN_HISTOGRAM = 50
ROOM_BANDS = ["1 room", "2 rooms", "3 rooms", "4 rooms", "5+ rooms"]


def overall(df: DataFrame, price="price_usd", per_sqm="sqm_usd", area="total_area",
            rooms="rooms", date="date") -> DataFrame:
    """One row describing the whole price distribution; no row below 20 prices."""
    p = finite(price)
    out = summarise(
        df, [],
        [F.count(p).alias("listings"), F.avg(p).alias("mean"), F.min(p).alias("minimum"),
         F.max(p).alias("maximum"), F.avg(finite(per_sqm)).alias("mean_per_sqm"),
         F.min(date).alias("posted_from"), F.max(date).alias("posted_to")],
        {price: {"median": .5, "p25": .25, "p75": .75, "p90": .9}, per_sqm: {"median_per_sqm": .5},
         area: {"median_area": .5}, rooms: {"median_rooms": .5}})
    return out.where(F.col("listings") >= MIN_PRICES).withColumn(
        "skew_mean_over_median_pct", pct_change("mean", "median"))


def group_stats(df: DataFrame, group: str, price="price_usd", per_sqm="sqm_usd", area="total_area") -> DataFrame:
    """Per-group price statistics, shares, distance from the national median, sample label."""
    rows = df.where(F.col(group).isNotNull() & finite(price).isNotNull())
    wanted = {price: {"median": .5, "p25": .25, "p75": .75}, per_sqm: {"median_per_sqm": .5}, area: {"median_area_sqm": .5}}
    directory = RankDirectory(rows, [group], list(wanted), [F.count("*").alias("listings"), F.avg(price).alias("mean")])
    ranked, country = directory.ranks([([group], None), ([], None)], wanted)  # both from the same two passes
    table = join_on(directory.groups(), ranked, [group], "left")
    national = country.select("median").scalar()
    everything = Window.partitionBy(F.lit(0))
    return table.select(
        group, "listings", "median", "mean", "p25", "p75", "median_per_sqm", "median_area_sqm",
        (F.col("listings") * 100.0 / F.sum("listings").over(everything)).alias("share_of_listings_pct"),
        pct_change("median", national).alias("vs_national_pct"),
        F.when(F.col("listings") >= MIN_GROUP_SAMPLE, "adequate")
         .otherwise("thin — indicative only").alias("sample"))


def ranking(stats: DataFrame, group: str) -> DataFrame:
    """Dearest and cheapest group, spread ratio and dispersion (population deviation).

    Ranks only adequately sampled groups when there is at least one.
    """
    adequate = F.col("listings") >= MIN_GROUP_SAMPLE
    ok = stats.withColumn("__any", F.max(adequate).over(Window.partitionBy(F.lit(0)))) \
              .where(adequate | ~F.col("__any"))
    out = ok.agg(
        F.count("*").alias("ranked"), F.count_if(adequate).alias("reliable_groups"),
        F.max_by(group, F.struct("median", group)).alias("most_expensive"), F.max("median").alias("top_median"),
        F.min_by(group, F.struct("median", group)).alias("cheapest"), F.min("median").alias("low_median"),
        (F.try_divide(F.stddev_pop("median"), F.avg("median")) * 100).alias("dispersion_pct"))
    several = F.col("ranked") >= 2
    return out.select("reliable_groups", "most_expensive", "top_median", "cheapest", "low_median",
                      F.when(several, ratio("top_median", "low_median")).alias("spread_ratio"),
                      F.when(several, F.col("dispersion_pct")).alias("dispersion_pct"))


def room_band(rooms="rooms"):
    whole = F.col(rooms).cast("int")
    out = F.lit("5+ rooms")
    for n in (4, 3, 2, 1):
        out = F.when(whole == n, ROOM_BANDS[n - 1]).otherwise(out)
    return F.when(F.col(rooms).isNotNull(), out)


def by_rooms(df: DataFrame, price="price_usd", per_sqm="sqm_usd", area="total_area") -> DataFrame:
    """Price by size band, in band order (column ``ord``)."""
    rows = df.where(F.col("rooms").isNotNull() & finite(price).isNotNull()).withColumn("size_band", room_band())
    out = summarise(rows, ["size_band"], [F.count("*").alias("listings"), F.avg(price).alias("mean")],
                    {price: {"median": .5}, per_sqm: {"median_per_sqm": .5}, area: {"median_area_sqm": .5}})
    bands = F.array(*[F.lit(b) for b in ROOM_BANDS])
    return out.withColumn("ord", F.array_position(bands, F.col("size_band"))).orderBy("ord")


def by_category(df: DataFrame, column: str, price="price_usd", per_sqm="sqm_usd",
                minimum: int = MIN_CATEGORY, top: int = 10) -> DataFrame:
    """Medians of the ten dearest categories seen at least 25 times; empty below two."""
    rows = df.where(F.col(column).isNotNull() & finite(price).isNotNull())
    out = summarise(rows, [column], [F.count("*").alias("listings")],
                    {price: {"median": .5}, per_sqm: {"median_per_sqm": .5}})
    kept = out.where(F.col("listings") >= minimum) \
        .withColumn("__groups", F.count("*").over(Window.partitionBy(F.lit(0))))
    return kept.where("__groups >= 2").drop("__groups") \
        .orderBy(F.desc("median"), column).limit(top)


def table_medians(df: DataFrame, keys: list[str], metric: str, unit: float = 1.0,
                  minimum: int = MIN_TABLE) -> DataFrame:
    """Count and median per group; a thin group keeps its row but not its median."""
    rows = df.where(finite(metric).isNotNull())
    out = summarise(rows, keys, [F.count("*").alias("listings")], {metric: {"median": .5}})
    return out.withColumn("median", F.when(F.col("listings") >= minimum, F.col("median") / unit))


def rental_yield(df: DataFrame, strata: list[str], metric: str = "sqm_usd", minimum: int = MIN_TABLE,
                 scale: float = 1200.0) -> DataFrame:
    """Annual gross yield (12 months, in percent) on strata holding enough rents and enough sales."""
    rows = df.where(F.col("kind").isin("rent", "sale") & finite(metric).isNotNull())
    for key in strata:
        rows = rows.where(F.col(key).isNotNull())
    sides = summarise(rows, [*strata, "kind"], [F.count("*").alias("n")], {metric: {"median": .5}})
    sides = sides.where(F.col("n") >= minimum)
    pick = lambda col, kind: F.max(F.when(F.col("kind") == kind, F.col(col)))
    out = sides.groupBy(*strata).agg(
        pick("n", "rent").alias("rent_n"), pick("n", "sale").alias("sale_n"),
        pick("median", "rent").alias("rent_median"), pick("median", "sale").alias("sale_median"))
    return out.where("rent_n IS NOT NULL AND sale_n IS NOT NULL").withColumn(
        "yield_pct", ratio(F.col("rent_median") * scale, "sale_median"))


def yield_summary(yields: DataFrame) -> DataFrame:
    """Range, middle and payback (years) of a yield table."""
    return yields.agg(
        F.count("yield_pct").alias("strata"), F.min("yield_pct").alias("low"), F.max("yield_pct").alias("high"),
        F.percentile("yield_pct", 0.5).alias("middle")).withColumn("payback_years", ratio(F.lit(100.0), "middle"))


def source_mix(df: DataFrame, keys=("source", "kind", "property")) -> DataFrame:
    """Listings and share per source and segment."""
    out = df.groupBy(*keys).agg(F.count("*").alias("listings"))
    return out.withColumn("share_pct", F.col("listings") * 100.0 / F.sum("listings").over(
        Window.partitionBy(F.lit(0))))


def unknown_share(df: DataFrame, column: str, unknown: str) -> DataFrame:
    hit = (F.col(column) == unknown) | F.col(column).isNull()
    return df.agg(F.count("*").alias("listings"), F.count_if(hit).alias("unclassified")).withColumn(
        "share_pct", ratio(F.col("unclassified") * 100.0, "listings"))


def contribution(df: DataFrame, group: str, value: str, period: str) -> DataFrame:
    """Share of the latest total and each group's part of the change since the first period.

    Groups absent from the latest period are not listed; a group absent from the first
    counts as NULL there.
    """
    totals = df.groupBy(group, period).agg(F.sum(value).alias("__v"))
    ends = totals.agg(F.min(period).alias("a"), F.max(period).alias("b"))
    a, b = ends.select("a").scalar(), ends.select("b").scalar()
    table = (totals.where((F.col(period) == a) | (F.col(period) == b)).groupBy(group).agg(
        F.max(F.when(F.col(period) == b, F.col("__v"))).alias("latest"),
        F.max(F.when(F.col(period) == a, F.col("__v"))).alias("first")))
    everything = Window.partitionBy(F.lit(0))
    latest_total, first_total = F.sum("latest").over(everything), F.sum("first").over(everything)
    change = F.col("latest") - F.col("first")
    return table.select(
        group, "latest", "first", (ratio("latest", latest_total) * 100).alias("share_pct"),
        pct_change("latest", "first").alias("change_pct"),
        (ratio(change, latest_total - first_total) * 100).alias("contribution_pct"),
    ).where("latest IS NOT NULL")


def concentration(df: DataFrame, group: str, value: str, period: str) -> DataFrame:
    """Herfindahl index, top and top-three shares at the latest period."""
    totals = df.groupBy(group, period).agg(F.sum(value).alias("__v"))
    latest = totals.agg(F.max(period)).scalar()
    shares = totals.where(F.col(period) == latest).select(
        group, ratio("__v", F.sum("__v").over(Window.partitionBy(F.lit(0)))).alias("s"))
    ranked = shares.withColumn("r", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.desc("s"), group)))
    return ranked.agg(
        F.count("*").alias("groups"), (F.sum(F.col("s") * F.col("s")) * 10000).alias("hhi"),
        F.max_by(group, F.struct("s", F.negative("r"))).alias("top_group"), (F.max("s") * 100).alias("top_share_pct"),
        (F.sum(F.when(F.col("r") <= 3, F.col("s"))) * 100).alias("top3_share_pct"))


def histogram(df: DataFrame, value: str, bins: int = 40, upper: float = 0.98) -> DataFrame:
    """Equal-width bins from the minimum to the 98th percentile; above it only a count.

    One row per bin; ``hidden`` repeats how many values lie beyond the last bin.
    """
    rows = df.select(finite(value).alias("v")).where("v IS NOT NULL")
    ends = measured(summarise(rows, [], [F.min("v").alias("lo"), F.count("v").alias("n")], {"v": {"p": upper}}))
    low, edge, n = (ends.select(c).scalar() for c in ("lo", "p", "n"))
    width = (edge - low) / float(bins)
    slot = F.least(F.floor(F.try_divide(F.col("v") - low, width)), F.lit(bins - 1)).cast("int")
    counted = rows.where(n >= MIN_HISTOGRAM).groupBy(
        F.when(F.col("v") <= edge, F.coalesce(slot, F.lit(0))).alias("bin")).agg(F.count("*").alias("listings"))
    everything = Window.partitionBy(F.lit(0))
    return counted.withColumn("hidden", F.coalesce(
        F.max(F.when(F.col("bin").isNull(), F.col("listings"))).over(everything), F.lit(0))) \
        .where("bin IS NOT NULL") \
        .select("bin", (low + F.col("bin") * width).alias("from_value"),
                (low + (F.col("bin") + 1) * width).alias("to_value"), "listings", "hidden")


def quantile_table(df: DataFrame, value: str) -> DataFrame:
    """The quantile rows printed beside the histogram."""
    probs = {"p10": .1, "p25": .25, "p50": .5, "p75": .75, "p90": .9}
    return quantiles(df, [], {value: probs}).unpivot([], list(probs), "statistic", "value")


def segment_bars(df: DataFrame, segment: str, value: str, period: str, top: int = 7) -> DataFrame:
    """Segment means at the latest period: the seven largest, then one bar for the mean of the rest."""
    means = df.groupBy(segment, period).agg(F.avg(value).alias("v"))
    latest = df.agg(F.max(period)).scalar()
    ranked = means.where((F.col(period) == latest) & F.col("v").isNotNull()).withColumn(
        "r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("v"), segment)))
    label = F.when(F.col("r") <= top, F.col(segment)).otherwise("Other")
    return ranked.groupBy(label.alias("segment")).agg(F.avg("v").alias("value"), F.min("r").alias("ord"))


def caveats(stats: DataFrame, has_dates: bool = True) -> DataFrame:
    """Flags a reader of a cross-section needs: concentration, thin groups, standing supply."""
    group = stats.columns[0]
    adequate = F.col("listings") >= MIN_GROUP_SAMPLE
    everything = Window.partitionBy(F.lit(0))
    ranked = stats.withColumn("__any", F.max(adequate).over(everything))
    best = F.max_by("share_of_listings_pct",
                    F.when(adequate | ~F.col("__any"), F.struct("median", group)))
    return ranked.agg(
        F.coalesce(best > 60, F.lit(False)).alias("concentrated"),
        F.count_if(~adequate).alias("thin_groups"), F.count("*").alias("groups"),
        F.lit(has_dates).alias("standing_supply"))
