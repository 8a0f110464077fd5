"""Fixed-weight asking-price index, its deflation, and the readings taken from it.

Inputs are the published aggregates (one row per quarter, place and market), whose size
does not grow with the number of adverts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.numbers import pct_change, pearson, ratio
from plinth.functions.places import UNKNOWN, region_position
from plinth.operators.archive import national

# Strata, thin limits and reading thresholds.
STRATA = ["region_uz", "market"]
MIN_QUARTER_LISTINGS = 100
MILLION = 1_000_000.0


def everything():
    """All rows of a small published table as one window partition."""
    return Window.partitionBy(F.lit(0))


def by_quarter():
    return everything().orderBy("quarter")


def quarter_label(quarter) -> Column:
    q = F.col(quarter) if isinstance(quarter, str) else quarter
    return F.concat(F.year(q).cast("string"), F.lit("-Ch"), F.quarter(q).cast("string"))


def fixed_weights(quarterly: DataFrame, strata: Sequence[str] = tuple(STRATA)) -> DataFrame:
    """Share of all listings held by each stratum that is present in every quarter."""
    quarters = quarterly.agg(F.count_distinct("quarter")).scalar()
    counts = quarterly.groupBy(*strata).agg(F.sum("listings").alias("n"), F.count_distinct("quarter").alias("seen"))
    return counts.where(F.col("seen") == quarters) \
        .withColumn("weight", ratio("n", F.sum("n").over(everything()))).select(*strata, "weight")


def index_series(quarterly: DataFrame, strata: Sequence[str] = tuple(STRATA), rates: DataFrame | None = None) -> DataFrame:
    """Weighted mean of stratum medians per quarter, first quarter = 100.

    Falls back to each quarter's own volumes where no stratum is seen in every quarter
    (``weighting`` says which).  ``rates`` (quarter, rate) adds the level in millions.
    """
    strata = list(strata)
    weights = fixed_weights(quarterly, strata)
    priced = quarterly.join(weights, strata, "left")
    usable = F.col("weight").isNotNull() & F.col("median_usd_sqm").isNotNull()
    w = F.when(usable, F.col("weight"))
    fixed = priced.groupBy("quarter").agg(
        F.sum("listings").alias("listings"),
        ratio(F.sum(w * F.col("median_usd_sqm")), F.sum(w)).alias("median_usd_sqm"),
        ratio(F.sum(F.when(F.col("weight").isNotNull(), F.col("listings"))) * 100, F.sum("listings")).alias("coverage"),
        F.count("weight").alias("strata"))
    any_fixed = weights.agg(F.count("*") > 0).scalar()
    volume = national(quarterly, "quarter").select(
        "quarter", "listings", "median_usd_sqm", F.lit(100.0).alias("coverage"), F.lit(0).cast("bigint").alias("strata"))
    levels = fixed.where(any_fixed & F.col("median_usd_sqm").isNotNull()).withColumn("weighting", F.lit("fixed")) \
        .unionByName(volume.where(~any_fixed).withColumn("weighting", F.lit("volume")))
    months = quarterly.groupBy("quarter").agg(F.max("months").alias("months"))
    base = F.first("median_usd_sqm").over(by_quarter().rowsBetween(Window.unboundedPreceding, 0))
    out = levels.join(months, "quarter").withColumn("index", ratio("median_usd_sqm", base) * 100)
    if rates is not None:
        out = out.join(rates.select("quarter", "rate"), "quarter", "left") \
                 .withColumn("som_sqm", F.col("median_usd_sqm") * F.col("rate") / MILLION).drop("rate")
    return out


def som_index(levels: DataFrame) -> DataFrame:
    """Local-currency level, first quarter = 100; empty unless every quarter has a rate."""
    complete = levels.withColumn("__gap", F.count_if(F.col("som_sqm").isNull()).over(everything())).where("__gap = 0")
    base = F.first("som_sqm").over(by_quarter().rowsBetween(Window.unboundedPreceding, 0))
    return complete.withColumn("som_index", ratio("som_sqm", base) * 100).select("quarter", "som_sqm", "som_index")


def price_level(cpi: DataFrame, quarters: DataFrame) -> DataFrame:
    """Quarterly price level from annual inflation, first quarter = 1; ``carried`` marks assumed years.

    Inflation compounds geometrically inside a year; a year without a figure takes the last
    published one; nothing is returned when the first year precedes the first figure.
    """
    ends = quarters.agg(F.year(F.min("quarter")).alias("a"), F.year(F.max("quarter")).alias("b"))
    known = cpi.agg(F.min("year").alias("k0"), F.max("year").alias("k1"), F.max_by("pct", "year").alias("last"))
    k0, k1, last = (known.select(c).scalar() for c in ("k0", "k1", "last"))
    years = ends.where(F.col("a") >= k0).select(F.explode(F.sequence("a", "b")).alias("year")).join(cpi, "year", "left")
    upto = everything().orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    years = years.withColumn("factor", 1 + F.coalesce("pct", last) / 100) \
        .withColumn("start", F.coalesce(F.exp(F.sum(F.ln("factor")).over(upto)), F.lit(1.0))) \
        .withColumn("carried", F.col("pct").isNull() & (F.col("year") > k1))
    rows = quarters.select("quarter").distinct().withColumn("year", F.year("quarter")).join(years, "year")
    raw = F.col("start") * F.pow("factor", F.quarter("quarter") / 4.0)
    first = F.first(raw).over(by_quarter().rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("quarter", (raw / first).alias("level"), "carried")


def real_index(som: DataFrame, level: DataFrame) -> DataFrame:
    """Local-currency index deflated by the price level."""
    return som.join(level, "quarter").select(
        "quarter", "som_index", "level", ratio("som_index", "level").alias("real_index"), "carried")


def real_growth(real: DataFrame) -> DataFrame:
    """Nominal, inflation and real growth between the ends, with the verdict (one point either way)."""
    out = real.agg(
        (F.max_by("som_index", "quarter") - 100).alias("nominal_pct"),
        ((ratio(F.max_by("level", "quarter"), F.min_by("level", "quarter")) - 1) * 100).alias("inflation_pct"),
        ((F.max_by("real_index", "quarter") / 100 - 1) * 100).alias("real_pct"),
        F.count_if("carried").alias("carried_quarters"))
    return out.withColumn("verdict", F.when(F.col("real_pct") > 1, "faster")
                          .when(F.col("real_pct") < -1, "slower").otherwise("level"))


def comparison(quarterly: DataFrame, group: str, quarters: DataFrame, rates: DataFrame | None = None,
               minimum: int = MIN_QUARTER_LISTINGS) -> DataFrame:
    """Two levels and two changes over three quarters, one row per group.

    ``quarters`` (quarter, k = 0..2, oldest first).  A thin cell is NULL but its row stays;
    levels are in local currency only if every quarter has a rate.
    """
    q = quarters.join(rates.select("quarter", "rate"), "quarter", "left") if rates is not None \
        else quarters.withColumn("rate", F.lit(None).cast("double"))
    local = q.agg((F.count_if(F.col("rate").isNull()) == 0) & (F.count("*") > 1)).scalar()
    value = F.when(local, F.col("median_usd_sqm") * F.col("rate") / MILLION).otherwise(F.col("median_usd_sqm"))
    cells = quarterly.join(q, "quarter").where(F.col(group) != UNKNOWN) \
        .withColumn("v", F.when(F.col("listings") >= minimum, value))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}")
    wide = cells.groupBy(group).agg(at(0), at(1), at(2), F.max(local).alias("local_currency"))
    return wide.select(
        group, region_position(group).alias("ord"), F.col("v1").alias("level_before"),
        pct_change("v1", "v0").alias("change_before_pct"), F.col("v2").alias("level"),
        pct_change("v2", "v1").alias("change_pct"), "local_currency").orderBy(F.asc_nulls_last("ord"), group)


def last_quarters(quarterly: DataFrame, n: int = 3) -> DataFrame:
    """The latest n quarters with k counting from the oldest."""
    kept = quarterly.select("quarter").distinct().orderBy(F.desc("quarter")).limit(n)
    return kept.withColumn("k", F.row_number().over(by_quarter()) - 1)


def thin_groups(quarterly: DataFrame, group: str, quarter, minimum: int = MIN_QUARTER_LISTINGS) -> DataFrame:
    return quarterly.where((F.col("quarter") == quarter) & (F.col("listings") < minimum)
                           & (F.col(group) != UNKNOWN)).select(group, "market", "listings")


def quarter_change(quarterly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each cell against the same cell one calendar quarter earlier."""
    before = quarterly.select(*keys, F.add_months("quarter", 3).alias("quarter"),
                              F.col("median_usd_sqm").alias("before"))
    return quarterly.select(*keys, "quarter", F.col("median_usd_sqm").alias("now")) \
        .join(before, [*keys, "quarter"]).withColumn("change_pct", pct_change("now", "before"))


def movement(quarterly: DataFrame, place: str = "region_uz") -> DataFrame:
    """Per market, latest quarter against the one before: places down, largest fall and rise."""
    ks = last_quarters(quarterly, 2)
    cells = quarterly.join(ks, "quarter").groupBy("market", place).agg(
        F.max(F.when(F.col("k") == 1, F.col("median_usd_sqm"))).alias("now"),
        F.max(F.when(F.col("k") == 0, F.col("median_usd_sqm"))).alias("before"))
    moves = cells.withColumn("move", pct_change("now", "before")).where("move IS NOT NULL")
    return moves.groupBy("market").agg(
        F.count("*").alias("places"), F.count_if(F.col("move") < 0).alias("down"),
        F.min("move").alias("largest_fall"), F.min_by(place, F.struct("move", place)).alias("fall_place"),
        F.max("move").alias("largest_rise"), F.max_by(place, F.struct("move", place)).alias("rise_place"))


def change_band(changes: DataFrame, column: str = "change_pct") -> DataFrame:
    """Inter-quartile band of the size of the changes."""
    return changes.agg(F.count(column).alias("n"), F.percentile(F.abs(column), 0.25).alias("low"),
                       F.percentile(F.abs(column), 0.75).alias("high"))


def breadth(changes: DataFrame, column: str = "change_pct") -> DataFrame:
    """Whether a quarter fell, rose or split: 70 % of the places (at least two) must agree."""
    out = changes.where(F.col(column).isNotNull()).agg(
        F.count("*").alias("places"), F.count_if(F.col(column) < 0).alias("falls"),
        F.count_if(F.col(column) > 0).alias("rises"))
    need = F.greatest(F.lit(2.0), F.col("places") * 0.7)
    return out.withColumn("shape", F.when(F.col("falls") >= need, "broad fall")
                          .when(F.col("rises") >= need, "broad rise").otherwise("mixed"))


def level_spread(table: DataFrame, group: str, level: str = "level") -> DataFrame:
    """Ends, ratio and the middle place of the latest levels (three or more places)."""
    rows = table.where(F.col(level).isNotNull()) \
        .withColumn("r", F.row_number().over(everything().orderBy(level, group)) - 1).withColumn("n", F.count("*").over(everything()))
    out = rows.agg(
        F.max("n").alias("places"), F.min_by(group, "r").alias("cheapest"), F.min(level).alias("low"),
        F.max_by(group, "r").alias("dearest"), F.max(level).alias("high"),
        F.max(F.when(F.col("r") == F.floor(F.col("n") / 2), F.col(group))).alias("middle"))
    return out.where("places >= 3").withColumn("spread_ratio", ratio("high", "low"))


def levels_shape(table: DataFrame, group: str, level: str = "median") -> DataFrame:
    """How far apart the ends sit, and whether a few places pull the top away."""
    middle = table.agg(F.percentile(level, 0.5)).scalar()
    out = table.where(F.col(level).isNotNull()).agg(
        F.count("*").alias("places"), F.max_by(group, F.struct(level, group)).alias("dearest"),
        F.min_by(group, F.struct(level, group)).alias("cheapest"),
        ratio(F.max(level), F.min(level)).alias("spread_ratio"), F.count_if(F.col(level) > middle).alias("above_middle"))
    return out.withColumn("shape", F.when(F.col("places") < 3, "few").when(F.col("spread_ratio") >= 2.5, "wide")
                          .when(F.col("above_middle") <= F.col("places") / 3, "stretched").otherwise("even"))


def segment_headline(table: DataFrame, group: str) -> DataFrame:
    """Places down of total, breadth class, the largest move and the dearest place."""
    moved = F.col("change_pct").isNotNull()
    out = table.agg(
        F.count_if(moved).alias("places"), F.count_if(F.col("change_pct") < 0).alias("down"),
        F.max_by(F.struct(group, "change_pct"), F.when(moved, F.struct(F.abs("change_pct"), group))).alias("m"),
        F.max_by(group, F.when(F.col("level").isNotNull(), F.struct("level", group))).alias("dearest"),
        F.count("level").alias("levels"))
    shape = F.when(F.col("down") >= F.col("places") * 0.7, "broad fall") \
        .when(F.col("down") <= F.col("places") * 0.3, "broad rise").otherwise("mixed")
    return out.where("places > 0 AND levels >= 2").select(
        "places", "down", shape.alias("shape"), F.col(f"m.{group}").alias("moved_most"),
        F.col("m.change_pct").alias("largest_move_pct"), "dearest")


def level_change_rank_correlation(table: DataFrame, level="level", change="change_pct") -> DataFrame:
    """Spearman of level and change over six or more places; converging at -0.4, diverging at +0.4."""
    def rank(c):
        return F.rank().over(everything().orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0
    rows = table.where(F.col(level).isNotNull() & F.col(change).isNotNull()) \
        .withColumn("a", rank(level)).withColumn("b", rank(change))
    out = rows.agg(F.count("*").alias("places"), pearson("a", "b").alias("rho")).where("places >= 6")
    return out.withColumn("reading", F.when(F.col("rho") <= -0.4, "converging")
                          .when(F.col("rho") >= 0.4, "diverging").otherwise("no pattern"))


def persistence(table: DataFrame) -> DataFrame:
    """Share of places that turned against the previous quarter or held on, with the pace."""
    before, now = F.col("change_before_pct"), F.col("change_pct")
    turned, held = before * now < 0, before * now > 0
    out = table.where(before.isNotNull() & now.isNotNull()).agg(
        F.count("*").alias("places"), F.count_if(turned).alias("turned"), F.count_if(held).alias("held"),
        F.avg(F.when(held, (now > 0).cast("double"))).alias("up_share"),
        (F.avg(F.when(held, F.abs(now))) - F.avg(F.when(held, F.abs(before)))).alias("pace"))
    return out.where("places >= 3").withColumn(
        "reading", F.when(F.col("turned") >= F.col("places") * 0.5, "reversal")
        .when(F.col("held") >= F.col("places") * 0.6,
              F.when(F.col("up_share") > 0.5, "continued rise").otherwise("continued fall")).otherwise("unclear"))


def pace(levels: DataFrame) -> DataFrame:
    """Last index change against the mean of the (up to) three before it; count and depth of falls."""
    steps = levels.withColumn("change", pct_change("index", F.lag("index").over(by_quarter()))) \
        .where("change IS NOT NULL").withColumn("back", F.row_number().over(everything().orderBy(F.desc("quarter"))))
    out = steps.agg(
        F.count("*").alias("steps"), F.max(F.when(F.col("back") == 1, F.col("change"))).alias("last_change"),
        F.avg(F.when(F.col("back").between(2, 4), F.col("change"))).alias("earlier_mean"),
        F.count_if(F.col("change") < 0).alias("falls"), F.min(F.when(F.col("change") < 0, F.col("change"))).alias("deepest"))
    gap = F.col("last_change") - F.col("earlier_mean")
    return out.where("steps >= 2").withColumn(
        "pace", F.when(F.abs(gap) < 0.3, "unchanged").when(gap > 0, "faster").otherwise("slower"))


def index_table(levels: DataFrame) -> DataFrame:
    """Printed index: quarter, months, level, coverage, listings, index, change."""
    return levels.select(
        quarter_label("quarter").alias("label"), "quarter", "months", F.col("median_usd_sqm").alias("level"), "coverage",
        "listings", "index", pct_change("index", F.lag("index").over(by_quarter())).alias("change_pct"))


def currency_effect(levels: DataFrame) -> DataFrame:
    """Dollar and local change between the first and last priced quarter."""
    rows = levels.where("som_sqm IS NOT NULL")
    change = lambda c: (ratio(F.max_by(c, "quarter"), F.min_by(c, "quarter")) - 1) * 100
    return rows.agg(F.count("*").alias("quarters"), change("median_usd_sqm").alias("dollar_pct"),
                    change("som_sqm").alias("local_pct")).where("quarters >= 2")


def rate_pass_through(rates: DataFrame) -> DataFrame:
    """Change of the exchange rate between the last two quarters; none below a tenth of a percent."""
    last = rates.withColumn("back", F.row_number().over(everything().orderBy(F.desc("quarter")))).where("back <= 2")
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("rate")))
    out = last.agg(at(1).alias("rate"), at(2).alias("rate_before")).withColumn("effect_pct", pct_change("rate", "rate_before"))
    return out.where("effect_pct IS NOT NULL").withColumn(
        "reading", F.when(F.abs("effect_pct") < 0.1, "none").when(F.col("effect_pct") < 0, "cheaper").otherwise("dearer"))


def partial_periods(quarterly: DataFrame) -> DataFrame:
    """Quarters observed in fewer than three months and years in fewer than twelve."""
    q = quarterly.groupBy("quarter").agg(F.max("months").cast("int").alias("months"))
    short = q.where("months > 0 AND months < 3").select(F.lit("quarter").alias("kind"), quarter_label("quarter").alias("label"), "months")
    y = q.groupBy(F.year("quarter").alias("y")).agg(F.sum("months").cast("int").alias("months"))
    years = y.where("months > 0 AND months < 12").select(F.lit("year").alias("kind"), F.col("y").cast("string").alias("label"), "months")
    return short.unionByName(years)


def annual_history(monthly: DataFrame) -> DataFrame:
    """Months, listings, listing-weighted level and change per year."""
    rows = monthly.groupBy(F.year("month").alias("year")).agg(
        F.count_distinct("month").alias("months"), F.sum("listings").alias("listings"),
        ratio(F.sum(F.col("median_usd_sqm") * F.col("listings")), F.sum("listings")).alias("median"))
    return rows.withColumn("change_pct", pct_change("median", F.lag("median").over(everything().orderBy("year"))))


def annual_reading(annual: DataFrame) -> DataFrame:
    """Total and annualised change, fastest and slowest year."""
    out = annual.where("median IS NOT NULL").agg(
        F.count("*").alias("years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.min_by("median", "year").alias("first_level"), F.max_by("median", "year").alias("last_level"),
        F.max_by("year", F.when(F.col("change_pct").isNotNull(), F.struct("change_pct", "year"))).alias("fastest_year"),
        F.max("change_pct").alias("fastest_pct"),
        F.min_by("year", F.when(F.col("change_pct").isNotNull(), F.struct("change_pct", "year"))).alias("slowest_year"),
        F.min("change_pct").alias("slowest_pct"))
    span = F.col("last_year") - F.col("first_year")
    total = pct_change("last_level", "first_level")
    yearly = (F.pow(ratio("last_level", "first_level"), F.try_divide(F.lit(1.0), span)) - 1) * 100
    return out.where("years >= 2").withColumn("total_pct", total).withColumn("annualised_pct", F.coalesce(yearly, total))


def across_gap(monthly: DataFrame) -> DataFrame:
    """Last month before the latest gap of a national series against the latest month.

    ``tiny_sample`` marks a latest month with under a tenth of the earlier listings.
    """
    nat = national(monthly, "month").withColumn("prev", F.lag("month").over(everything().orderBy("month")))
    gap = nat.where("prev IS NOT NULL AND months_between(month, prev) > 1").agg(
        F.max_by("prev", "month").alias("before"), F.max("month").alias("resumed"))
    rows = nat.select("month", "listings", "median_usd_sqm")
    before, last = gap.select("before").scalar(), rows.agg(F.max("month")).scalar()
    out = rows.agg(
        F.max(F.when(F.col("month") == before, F.col("month"))).alias("before_month"),
        F.max(F.when(F.col("month") == before, F.col("median_usd_sqm"))).alias("before_level"),
        F.max(F.when(F.col("month") == before, F.col("listings"))).alias("before_listings"),
        F.max(F.when(F.col("month") == last, F.col("month"))).alias("latest_month"),
        F.max(F.when(F.col("month") == last, F.col("median_usd_sqm"))).alias("latest_level"),
        F.max(F.when(F.col("month") == last, F.col("listings"))).alias("latest_listings"))
    return out.where("before_month IS NOT NULL").withColumn("change_pct", pct_change("latest_level", "before_level")) \
        .withColumn("tiny_sample", F.col("latest_listings") < F.col("before_listings") / 10)


def history_with_gaps(monthly: DataFrame) -> DataFrame:
    """National monthly level with every unobserved month as a NULL row."""
    from plinth.operators.windows import month_spine
    nat = national(monthly, "month")
    return month_spine(nat, [], "month").join(nat, "month", "left")
