"""Capacity bucketing: split rows by place, then by price halves, until every bucket fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators.order_stats import join_on
from plinth.session import cut_lineage, measured

# Price axis (wider where the data go beyond it) and depth of the halving.
PRICE_FLOOR, PRICE_CEILING = 0.0, 1e12
MAX_DEPTH = 16


def capacity_buckets(rows: DataFrame, places: Sequence[str], price: str, capacity: int) -> DataFrame:
    """(places..., level, low, high, rows): a set of buckets that covers the input exactly once.

    Only counts per bucket travel.  The place levels are decided from one count per full
    place path; price bands are then halved (geometrically, since prices are skewed)
    round by round for the buckets that still overflow.  Rows without a price in such a
    bucket are a bucket of their own, with no bounds.
    """
    places = list(places)
    # Copies of a price collapse to a count, in the one pass over the rows; all else comes from these counts.
    priced = measured(rows.select(*places, F.floor(price).cast("double").alias("__p")).groupBy(*places, "__p").agg(F.count("*").alias("c")))
    full = measured(priced.groupBy(*places).agg(F.sum("c").alias("n"), F.min("__p").alias("a"), F.max("__p").alias("b")))
    ends = full.agg(F.min("a").alias("a"), F.max("b").alias("b")).first()
    floor = min(PRICE_FLOOR, ends["a"] if ends["a"] is not None else PRICE_FLOOR)
    ceiling = max(PRICE_CEILING, ends["b"] if ends["b"] is not None else PRICE_CEILING)
    # Shallowest level at which the prefix of a path fits, else the deepest one.
    level = F.lit(len(places))
    sized = full.withColumn("t0", F.sum("n").over(Window.partitionBy(F.lit(0))))
    for depth in range(1, len(places) + 1):
        sized = sized.withColumn(f"t{depth}", F.sum("n").over(Window.partitionBy(*places[:depth])))
    for depth in range(len(places), -1, -1):
        level = F.when(F.col(f"t{depth}") <= capacity, depth).otherwise(level)
    sized = sized.withColumn("level", level)
    prefix = [F.when(F.col("level") > i, F.col(p)).alias(p) for i, p in enumerate(places)]
    buckets = sized.select(*prefix, "level", "n").groupBy(*places, "level").agg(F.sum("n").alias("rows"))
    bands = buckets.select(*places, "level", F.lit(floor).alias("low"), F.lit(ceiling).alias("high"), "rows",
                           F.lit(0).alias("depth"))
    bands = cut_lineage(bands)
    done = bands.where(F.col("rows") <= capacity)
    over = bands.where(F.col("rows") > capacity)
    deep = over.select(*places, "level")
    unpriced = join_on(priced.where("__p IS NULL"), deep, places, "inner")
    done = done.unionByName(unpriced.select(*places, "level", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
                                            F.col("c").alias("rows"), F.lit(0).alias("depth")))
    for depth in range(1, MAX_DEPTH + 1):
        if over.isEmpty():
            break
        middle = F.floor(F.sqrt(F.greatest("low", F.lit(1.0)) * F.col("high")))
        middle = F.when((middle > F.col("low")) & (middle < F.col("high")), middle) \
            .otherwise(F.floor((F.col("low") + F.col("high")) / 2)).cast("double")
        can = F.col("high") - F.col("low") >= 2
        halves = over.where(can).withColumn("mid", middle).select(
            *places, "level", F.inline(F.array(
                F.struct(F.col("low"), F.col("mid").alias("high")),
                F.struct((F.col("mid") + 1).alias("low"), F.col("high")))))
        counted = join_on(priced, halves, places, "inner").where(F.col("__p").between(F.col("low"), F.col("high"))) \
            .groupBy(*places, "level", "low", "high").agg(F.sum("c").alias("rows"))
        counted = cut_lineage(join_on(halves, counted.drop("level"), [*places, "low", "high"]).select(
            *places, "level", "low", "high", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(depth).alias("depth")))
        done = done.unionByName(over.where(~can)).unionByName(counted.where(F.col("rows") <= capacity))
        over = counted.where(F.col("rows") > capacity)
    return done.unionByName(over)


def bucket_table(buckets: DataFrame, capacity: int) -> DataFrame:
    """Buckets with rows, and whether each fits (an unsplittable one is reported, not hidden)."""
    return buckets.where("rows > 0").withColumn("fits", F.col("rows") <= capacity)


def coverage(rows: DataFrame) -> DataFrame:
    """Listings and queries per category and the share each category contributes."""
    out = rows.groupBy("category").agg(F.count("*").alias("listings"), F.count_distinct("query").alias("queries"))
    return out.withColumn("share_pct", F.col("listings") * 100.0 / F.sum("listings").over(Window.partitionBy(F.lit(0))))


def unreachable(buckets: DataFrame, capacity: int) -> DataFrame:
    return buckets.where(F.col("rows") > capacity)
