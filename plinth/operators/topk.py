"""Top-k, ranking and thinning operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.places import region_position
from plinth.operators.order_stats import join_on, numbered
from plinth.session import measured


def top_n(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows by the given order: partial top-n per task, merged."""
    return df.orderBy(*order).limit(n)


def extremes(df: DataFrame, value: str, label: str, n: int) -> DataFrame:
    """The n smallest and the n largest rows; all rows when there are fewer than both."""
    rows = df.where(F.col(value).isNotNull())
    low = top_n(rows, n, F.asc(value), label).withColumn("side", F.lit("low"))
    high = top_n(rows, n, F.desc(value), F.desc(label)).withColumn("side", F.lit("high"))
    return low.unionByName(high).groupBy(*df.columns).agg(F.min("side").alias("side"))


def cheapest_and_dearest(df: DataFrame, value: str, label: str, n: int = 3) -> DataFrame:
    rows = df.where(F.col(value).isNotNull())
    low = top_n(rows, n, F.asc(value), label).select(F.lit("cheapest").alias("side"), label, value)
    return low.unionByName(top_n(rows, n, F.desc(value), label).select(F.lit("dearest").alias("side"), label, value))


def largest_move(df: DataFrame, change: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """The row of largest absolute change per key."""
    moved = F.when(F.col(change).isNotNull(), F.struct(F.abs(change).alias("a"), F.col(label)))
    return df.groupBy(*keys).agg(F.max_by(F.struct(label, change), moved).alias("m")).select(*keys, "m.*")


def top_per_group(df: DataFrame, keys: Sequence[str], score: str, label: str, n: int = 5) -> DataFrame:
    """The n best rows of every group, best first.

    The rank filter is pushed below the shuffle as a window group limit, so a hot group
    sends n rows per task, not all of its rows.
    """
    final = Window.partitionBy(*keys).orderBy(F.desc(score), label)
    return df.withColumn("place", F.row_number().over(final)).where(F.col("place") <= n)


def best_overall(df: DataFrame, score: str, label: str, n: int = 40) -> DataFrame:
    return top_n(df, n, F.desc(score), label)


def fixed_order(df: DataFrame, region: str) -> DataFrame:
    """Known regions in their printed order, unknown names after them alphabetically."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("__p"), region)
    return df.withColumn("__p", region_position(region)).withColumn("place", F.row_number().over(order)).drop("__p")


def thin_keep_last(df: DataFrame, order: str, limit: int = 24) -> DataFrame:
    """At most ``limit`` evenly spaced rows of a table, the last one always among them."""
    rows = numbered(df, order).withColumn("__n", df.agg(F.count("*")).scalar())
    step = F.ceil(F.col("__n") / F.lit(float(limit - 1)))
    small = F.col("__n") <= limit
    return rows.where(small | ((F.col("row_no") - 1) % step == 0) | (F.col("row_no") == F.col("__n"))).drop("__n")


def thin_systematic(df: DataFrame, order: str, budget: int, tie: Sequence[str] = ()) -> DataFrame:
    """Every k-th row by a numeric key so that at most ``budget`` rows remain.

    A sampling operator, off unless asked for: nothing in this package needs it.
    """
    n = df.agg(F.count("*").alias("n"))
    step = F.greatest(F.ceil(n.scalar() / F.lit(float(budget))), F.lit(1))
    return numbered(df, order, tie).where((F.col("row_no") - 1) % step == 0)


def budget_quotas(counts: DataFrame, budget: int) -> DataFrame:
    """Rows allowed per file: proportional where the count is known, an equal share where it is not.

    ``counts`` (file, rows); a NULL count is unknown.
    """
    facts = counts.agg(F.sum("rows").alias("known"), F.count("*").alias("files"), F.count("rows").alias("counted"))
    known, files, counted = (facts.select(c).scalar() for c in ("known", "files", "counted"))
    equal = F.lit(float(budget)) / files
    rest = F.lit(float(budget)) - equal * (files - counted)
    share = F.floor(F.try_divide(rest * F.col("rows"), known))
    return counts.withColumn("quota", F.greatest(F.lit(1), F.coalesce(
        F.least(share, F.col("rows")), F.floor(equal))).cast("bigint"))


def thin_by_quota(df: DataFrame, file: str, order: str, quotas: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """``quotas`` (file, rows, quota) applied: exactly ``quota`` evenly spaced rows of each file stay.

    Row i of n stays where i * quota / n passes a whole number, so a file's last row always does.
    A file whose quota covers its rows keeps all of them; its rows are counted here where unknown.
    A sampling operator, off unless asked for.
    """
    rows = numbered(df, order, tie, out="__i", keys=[file])
    sizes = df.groupBy(file).agg(F.count("*").alias("__n"))
    sizes = measured(join_on(sizes, quotas.select(F.col("file").alias(file), F.col("quota").alias("__q")), [file], "left"))
    share = lambda i: F.floor(i * F.col("__q") / F.col("__n"))
    keep = F.col("__q").isNull() | (F.col("__q") >= F.col("__n")) | (share(F.col("__i")) > share(F.col("__i") - 1))
    return join_on(rows, sizes, [file], "inner").where(keep).drop("__i", "__n", "__q")


def sampling_note(available: DataFrame, kept: DataFrame) -> DataFrame:
    """One row when less than 95 % of the available rows are read, none otherwise."""
    k = kept.agg(F.count("*")).scalar()
    out = available.agg(F.count("*").alias("available")).withColumn("kept", k)
    return out.where(F.col("kept") < F.col("available") * 0.95) \
        .withColumn("share_pct", F.col("kept") * 100.0 / F.col("available"))
