"""Snapshot arrivals as streams: append log, de-duplication, history, late months, daily windows."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.order_stats import keep_first

LOG_KEYS = ["listing_id", "captured_at", "category"]


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a TIMESTAMP; files may carry TIMESTAMP_NTZ."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def append_new(batch: DataFrame, log_path: str, keys: Sequence[str] = tuple(LOG_KEYS)) -> None:
    """Append the rows whose key the log does not hold yet; replaying a batch changes nothing.

    The log is partitioned by capture day and only the days of the batch are read back.
    """
    spark = batch.sparkSession
    keys = list(keys)
    fresh = keep_first(batch, keys, keys).withColumn("captured_day", F.to_date("captured_at"))
    if _exists(spark, log_path):
        days = [r[0] for r in fresh.select("captured_day").distinct().collect()]
        known = spark.read.parquet(log_path).where(F.col("captured_day").isin(days)).select(*keys)
        fresh = fresh.join(known, keys, "left_anti")
    fresh.write.mode("append").partitionBy("captured_day").parquet(log_path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def stream_to_log(stream: DataFrame, log_path: str, checkpoint: str, keys: Sequence[str] = tuple(LOG_KEYS)):
    """Idempotent append of every micro-batch; runs through what is available, then stops."""
    return (stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, log_path, keys))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def deduplicated(stream: DataFrame, keys: Sequence[str], time: str = "ts", delay: str = "1 day") -> DataFrame:
    """First arrival of every key within the watermark; state is dropped behind it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def listing_history(observations: DataFrame, key: str = "listing_id", seen: str = "captured_at") -> DataFrame:
    """First and last seen and the number of distinct observations per listing.

    Absence from a later snapshot is not a sale: nothing is ever removed.
    """
    return observations.groupBy(key).agg(
        F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.count_distinct(seen).alias("observations"))


def history_stream(stream: DataFrame, key: str = "listing_id", seen: str = "captured_at", price: str = "price") -> DataFrame:
    """The same history kept as streaming state (update or complete mode), with the last price."""
    return stream.groupBy(key).agg(
        F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.count("*").alias("observations"),
        F.max_by(price, seen).alias("last_price"))


def repricings(observations: DataFrame, key: str = "listing_id", seen: str = "captured_at", price: str = "price") -> DataFrame:
    """Observations whose price differs from the previous one of the same listing."""
    from pyspark.sql import Window
    before = F.lag(price).over(Window.partitionBy(key).orderBy(seen))
    return observations.withColumn("price_before", before).where(F.col("price_before") != F.col(price))


def daily_windows(stream: DataFrame, time: str = "ts", group: str = "event_type", value: str = "value",
                  delay: str = "1 day") -> DataFrame:
    """Daily count and sum per type in append mode; a day is emitted once the watermark passes it."""
    return (stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w"), group)
            .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
            .select(F.to_date("w.start").alias("day"), group, "n", "total"))


def replace_months(batch: DataFrame, path: str, month: str = "month", run: int = 0, part: int = 0) -> None:
    """Write one micro-batch of a run: a month of a newer run replaces that month, and no other.

    Parts of one run add up; a part that is written again replaces itself.
    """
    (batch.withColumn("__run", F.lit(run)).withColumn("__part", F.lit(part)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(month, "__run", "__part").parquet(path))


def read_months(spark: SparkSession, path: str, month: str = "month") -> DataFrame:
    """Every month as its newest run left it."""
    rows = spark.read.option("basePath", path).parquet(path)
    newest = rows.groupBy(F.col(month).alias("__m")).agg(F.max("__run").alias("__newest"))
    return rows.join(newest, rows[month].eqNullSafe(newest["__m"]) & (F.col("__run") == F.col("__newest"))) \
        .drop("__m", "__run", "__newest", "__part")


def stream_months(stream: DataFrame, path: str, checkpoint: str, month: str = "month", run: int = 0):
    """One run over what has arrived; a re-run takes a larger ``run`` and a checkpoint of its own."""
    return (stream.writeStream.foreachBatch(lambda batch, part: replace_months(batch, path, month, run, part))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the session's checkpoint folder (shared on a cluster)."""
    from uuid import uuid4

    from plinth.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"{name}-{uuid4().hex}")
