"""Any table to indicators: profile, tidy panel, regrain, summaries, breaks, regions, drivers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.periods import from_parts, numeric_period, period_date
from plinth.operators import drivers, panel, profile, regional, series
from plinth.operators.clean import cleaned
from plinth.session import cut_lineage


def understand(table: DataFrame, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cleaned table, column profile with roles, relevance verdicts)."""
    df = cleaned(table)
    roles = profile.classify_table(df, overrides)
    return df, roles, profile.relevance(roles)


def has_day_first(df: DataFrame, column: str) -> bool:
    """Whether a text column writes 25/12/2024: more rows of the whole column can only be read that way than the other."""
    rows = df.agg(*[F.count(period_date(F.col(column), day_first, strict=True)).alias(f"n{day_first:d}") for day_first in (False, True)]).first()
    return rows["n1"] > rows["n0"]


# Names of the columns that make up a date when no single column does.
YEAR, MONTH, QUARTER = r"^(year|yil|год)$", r"^(month|oy|месяц|mon)$", r"^(quarter|chorak|квартал|qtr|q)$"


def _named(df: DataFrame, pattern: str) -> str | None:
    return next((c for c in df.columns if re.search(pattern, c.lower())), None)


def part_columns(df: DataFrame) -> dict[str, str]:
    """The year, month and quarter columns of a table, as far as it has them."""
    found = {"year": _named(df, YEAR), "month": _named(df, MONTH), "quarter": _named(df, QUARTER)}
    return {k: c for k, c in found.items() if c} if found["year"] else {}


def with_dates(df: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """(table with this column as a date, columns the date was made of), decided by one aggregate over the column.

    Texts are read in the way more of the column can be read, then the other way; numbers by their range as years,
    YYYYMM or YYYYMMDD.  Year, month and quarter columns are used where fewer than half of the rows give a date and they
    give more, or the column is the year itself and they give no fewer.
    """
    parts = part_columns(df)
    x, kind = F.col(f"`{column}`"), dict(df.dtypes)[column]
    if kind == "string":
        day_first = has_day_first(df, column)
        date = F.coalesce(period_date(x, day_first), period_date(x, not day_first))
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        date = x.cast("date")
    else:
        ends = df.agg(F.min(x.cast("double")).alias("low"), F.max(x.cast("double")).alias("high")).first()
        date = numeric_period(x, F.lit(ends.low), F.lit(ends.high))
    if not parts or (list(parts) == ["year"] and column == parts["year"]):
        return df.withColumn(column, date), [column]
    at = {k: F.col(f"`{c}`") for k, c in parts.items()}
    combined = from_parts(at["year"], at.get("month"), at.get("quarter"))
    n = df.agg(F.count("*").alias("rows"), F.count(date).alias("single"), F.count(combined).alias("combined")).first()
    better = (2 * n.single < n.rows and n.combined > n.single) or (column == parts["year"] and n.combined >= n.single)
    return df.withColumn(column, combined if better else date), sorted({column, *parts.values()} if better else {column})


def tidy_panel(df: DataFrame, roles: DataFrame, verdicts: DataFrame, name: str = "table") -> tuple[DataFrame, DataFrame]:
    """(tidy panel, metric roles) from the picked date, region and segment columns."""
    picked = {r.role: r.column_name for r in profile.pick_columns(roles).collect()}
    parts = part_columns(df)
    if "date" not in picked and len(parts) > 1:
        picked["date"] = parts["year"]
    if "date" not in picked:
        raise ValueError("no date column found")
    df, used = with_dates(df, picked["date"])
    kept = {r.column_name for r in verdicts.where("keep").collect()} - set(picked.values()) - set(used)
    metrics = roles.where(F.col("column_name").isin(sorted(kept)) & ~F.col("role").isin("identifier", "unit", "segment", "region"))
    named = metrics.select(F.col("column_name").alias("metric"), "role")
    tidy = panel.melt(df, picked["date"], [r.metric for r in named.collect()], picked.get("region"), picked.get("segment"), name)
    return tidy, named


class Understood(NamedTuple):
    """What one table of a dataset is, and its panel (None where it has no dates or no metric)."""

    name: str
    df: DataFrame
    roles: DataFrame
    verdicts: DataFrame
    tidy: DataFrame | None
    named: DataFrame | None
    grain: str


def understood(name: str, table: DataFrame, overrides: DataFrame | None = None) -> Understood:
    df, roles, verdicts = understand(table, overrides)
    roles = cut_lineage(roles)  # one row for each column, asked for many times
    verdicts = cut_lineage(profile.relevance(roles))
    picked = {r.role for r in profile.pick_columns(roles).collect()}
    if "date" not in picked and len(part_columns(df)) < 2:
        return Understood(name, df, roles, verdicts, None, None, "none")
    tidy, named = tidy_panel(df, roles, verdicts, name)
    if named.isEmpty():
        return Understood(name, df, roles, verdicts, None, None, "none")
    tidy = cut_lineage(tidy)
    return Understood(name, df, roles, verdicts, tidy, cut_lineage(named), panel.grain_of(tidy, []).first()["grain"])


def scored(tables: Sequence[Understood]) -> DataFrame:
    """Score of each table and which is the primary one; one row for each table is built on the driver."""
    facts = []
    for t in tables:
        picked = {r.role for r in profile.pick_columns(t.roles).collect()}
        metrics = {r.role for r in t.named.collect()} if t.named is not None else set()
        rows = t.roles.agg(F.max("rows")).first()[0] or 0
        facts.append((t.name, rows, t.tidy is not None, "region" in picked, "segment" in picked,
                      t.named.count() if t.named is not None else 0, bool(metrics & {"price", "price_per_sqm"}), t.grain))
    schema = "table_name string, rows long, has_date boolean, has_region boolean, has_segment boolean, metrics int, has_price boolean, grain string"
    return profile.table_scores(tables[0].df.sparkSession.createDataFrame(facts, schema))


def _sums(named: DataFrame) -> list[str]:
    return [r.metric for r in named.where(F.col("role").isin(sorted(panel.SUM_ROLES))).collect()]


def analyse(table: DataFrame, overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    """Indicator tables of one dataset, at quarterly grain for finer input."""
    return analyse_tables({"table": table}, overrides)


def analyse_tables(tables: dict[str, DataFrame], overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    """Indicator tables of a dataset of several tables (those of a folder, say).

    The table of the highest score is the primary one; metrics it does not have are taken from the others, in order of
    score, at the grain of its panel.  Tables without dates or metrics are listed in ``tables`` and add nothing; a
    dataset in which no table has both is refused.  Series are made regular before trend, breaks and projection.
    """
    known = {t.name: t for t in (understood(name, table, overrides) for name, table in tables.items())}
    scores = cut_lineage(scored(list(known.values()))) if known else None
    order = [known[r.table_name] for r in scores.orderBy(F.desc("score"), "table_name").collect()] if known else []
    order = [t for t in order if t.tidy is not None]
    if not order:
        raise ValueError("no date column found")
    primary, roles, verdicts, grain = order[0], order[0].roles, order[0].verdicts, order[0].grain
    target = panel.GRAIN_TARGET.get(grain)
    fitted = [panel.regrain(t.tidy, _sums(t.named), target) if target else t.tidy.drop("source_table") for t in order]
    tidy = cut_lineage(panel.merge_supporting(*fitted))
    named = primary.named
    for other in order[1:]:
        named = named.unionByName(other.named.join(named.select("metric"), "metric", "left_anti"))
    sums = _sums(named)
    per_year = {"quarter": 4, "year": 1}.get(target, panel.PERIODS_PER_YEAR.get(grain, 12))
    step = target or {"quarterly": "quarter", "annual": "year"}.get(grain, "month")
    raw = panel.usable_series(panel.national_series(tidy, sums))
    national = cut_lineage(panel.regularised(raw, ["metric"], step))
    head = panel.pick_headline(national, named).first()
    out = {
        "tables": scores, "pairs": profile.pair_tests(primary.df, roles), "profile": roles, "relevance": verdicts, "panel": tidy, "national": national,
        "summary": series.summary(national, ["metric"], named), "trend": series.trend(national, ["metric"], per_year),
        "breaks": series.breakpoints(national, ["metric"]),
        "projection": series.line_projection(national, ["metric"], max(2, per_year // 2), step),
        "regions": regional.compare(tidy, "region", sums), "convergence": regional.convergence(tidy, "region", sums),
        "coverage": profile.coverage_record(tidy),
    }
    if head is not None:
        growth = drivers.growth(national, per_year)
        out["drivers"] = drivers.links(growth, named, head["metric"], head["role"])
        out["correlations"] = drivers.correlation_matrix(growth)
    return out
