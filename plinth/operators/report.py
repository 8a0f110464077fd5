"""The tables a report prints, as projections of the analytic operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overall_rows(overall: DataFrame) -> DataFrame:
    """Distribution as (statistic, value) rows."""
    names = ["listings", "median", "mean", "p25", "p75", "minimum", "maximum"]
    return overall.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "statistic", "value")


def region_rows(stats: DataFrame, group: str) -> DataFrame:
    return stats.select(group, "listings", "median", "vs_national_pct", "share_of_listings_pct", "sample") \
        .orderBy(F.desc("median"), group)


def dashboard_rows(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Indicator dashboard: rates move in points, everything else in percent."""
    points = F.col("change_unit") == "pp"
    return summary.select(
        *keys, "latest", F.col("end").alias("as_at"),
        F.when(points, F.col("yoy_pp")).otherwise(F.col("yoy_pct")).alias("yoy"),
        F.col("change_unit").alias("yoy_unit"), "total_change_pct", "cagr_pct", F.col("maximum").alias("peak"),
        "pct_from_peak", "direction")


def break_rows(breaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return breaks.withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))


def driver_rows(links: DataFrame, top: int = 14) -> DataFrame:
    """The strongest links, largest absolute correlation first."""
    return links.orderBy(F.desc(F.abs("correlation")), "driver").limit(top)


def regression_rows(coefficients: DataFrame) -> DataFrame:
    """Coefficient rows and one row of model fit."""
    rows = coefficients.select("variable", "coefficient", "std_error", "t_stat", "p_value",
                               F.lit(None).cast("string").alias("fit"))
    fit = coefficients.agg(F.max("r_squared").alias("r2"), F.max("adj_r_squared").alias("adj"), F.max("n").alias("n")) \
        .where("n IS NOT NULL")
    none = F.lit(None).cast("double")
    return rows.unionByName(fit.select(
        F.lit("Model fit").alias("variable"), none.alias("coefficient"), none.alias("std_error"), none.alias("t_stat"),
        none.alias("p_value"), F.format_string("R2 %.3f, adj. %.3f, n %d", "r2", "adj", "n").alias("fit")))


def ranked(table: DataFrame, prop: str, value: str = "median", label: str = "region", top: int | None = None) -> DataFrame:
    """Rows of one property type that carry a median, dearest first."""
    out = table.where((F.col("property") == prop) & F.col(value).isNotNull()).orderBy(F.desc(value), label)
    return out.limit(top) if top else out


def latest_in_force(events: DataFrame, labels: DataFrame, n: int = 12) -> DataFrame:
    """Latest events still in force with their category spelled out."""
    return events.where("still_in_force").join(labels, "category", "left") \
        .orderBy(F.desc("date"), "title").limit(n).select("date", "title", "category", "label", "direction")


def indicator_table(obs: DataFrame) -> DataFrame:
    """Latest value per indicator, printed with its own number of decimals."""
    latest = obs.where("value IS NOT NULL").groupBy("name").agg(
        F.max(F.struct("period", "value", "unit", "decimals")).alias("r")).select("name", "r.*")
    scale = F.pow(F.lit(10.0), F.col("decimals"))
    return latest.select("name", "period", "unit", (F.round(F.col("value") * scale) / scale).alias("value"))


def notes_tally(notes: DataFrame) -> DataFrame:
    """One row per distinct note with the number of files it came from, of all files."""
    files = notes.agg(F.count_distinct("file")).scalar()
    return notes.groupBy("note").agg(F.count_distinct("file").alias("files")).withColumn("of_files", files)


def source_overview(profiles: DataFrame) -> DataFrame:
    return profiles.select("table_name", "rows", "columns", "grain", "score",
                           (F.col("score") == F.max("score").over(Window.partitionBy(F.lit(0)))).alias("selected"))


def series_rules(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rule codes per series: strong growth, falling prices, growth and volatility risks."""
    rules = F.array_compact(F.array(
        F.when(F.col("cagr_pct") > 12, "growth"),
        F.when((F.col("yoy_pct") < 0) & ~F.coalesce(F.col("cagr_pct") > 12, F.lit(False)), "falling"),
        F.when(F.col("cagr_pct") > 15, "risk_growth"), F.when(F.col("volatility_pct") > 25, "risk_volatility")))
    return summary.select(*keys, F.explode(rules).alias("code"))


def market_rules(convergence: DataFrame, concentration: DataFrame, links: DataFrame, seasonality: DataFrame) -> DataFrame:
    """Rule codes of a market: diverging regions, concentration, a leading indicator, seasonality."""
    code = lambda df, cond, name: df.where(cond).limit(1).select(F.lit(name).alias("code"))
    return (code(convergence, F.col("convergence") == "diverging", "diverging")
            .unionByName(code(concentration, F.col("top_share_pct") > 40, "concentrated"))
            .unionByName(code(links, F.col("best_lag") > 0, "leading_indicator"))
            .unionByName(code(seasonality, F.col("detected"), "seasonal")))


def price_income_gap(summary: DataFrame, roles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compound growth of prices minus that of incomes."""
    named = summary.drop("role").join(roles, "metric")
    pick = lambda role, out: named.where(F.col("role") == role).select(*keys, F.col("cagr_pct").alias(out))
    return pick("price", "price_cagr").join(pick("income", "income_cagr"), list(keys)) \
        .withColumn("gap", F.col("price_cagr") - F.col("income_cagr")).where("gap IS NOT NULL")
