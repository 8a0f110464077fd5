"""Writers: snapshots, published aggregates, small dimension caches, CSV tables, run record."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.archive import TABLE_KEYS


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Dated snapshot: one directory per capture day, put in place by the output committer."""
    rows.write.mode("append").partitionBy("captured_at").parquet(path)


def write_published(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_published(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """All published tables, or None when one is missing or lacks its key columns."""
    out = {}
    for name, keys in TABLE_KEYS.items():
        try:
            df = spark.read.parquet(f"{folder}/{name}")
        except Exception:  # noqa: BLE001  (absent or unreadable: rebuild everything)
            return None
        if not set(keys) <= set(df.columns):
            return None
        out[name] = df
    return out


def published_or_built(spark: SparkSession, folder: str, build, rebuild: bool = False) -> dict[str, DataFrame]:
    """Reuse the published tables if all of them are usable, else build and write all."""
    tables = None if rebuild else read_published(spark, folder)
    if tables is None:
        write_published(build(), folder)
        tables = read_published(spark, folder)
    return tables


def write_dimension(df: DataFrame, path: str) -> None:
    df.withColumn("fetched", F.current_date()).write.mode("overwrite").parquet(path)


def fresh_dimension(spark: SparkSession, path: str, days: int | None = None) -> DataFrame:
    """A cached dimension; with ``days`` only rows fetched that recently."""
    df = spark.read.parquet(path)
    return df.where(F.col("fetched") >= F.date_sub(F.current_date(), days)) if days is not None else df


def write_csv_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Every report table as CSV with a header, written by its own tasks."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_run_record(sections: Mapping[str, DataFrame], path: str) -> None:
    """Settings, findings and coverage as JSON lines (section, body)."""
    parts = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("body"))
             for name, df in sections.items()]
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").json(path)
