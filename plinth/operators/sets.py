"""Set operations with a stated priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.order_stats import keep_first


def stack(*tables: DataFrame) -> DataFrame:
    """Union all by name; a column missing on one side is NULL there."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def jaccard(a: Sequence[str], b: Sequence[str]) -> float:
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def merge_tables(tables: dict[str, DataFrame], share: float = 0.6) -> dict[str, DataFrame]:
    """Stack tables whose columns overlap by 60 %, keep the others side by side.

    Works on schemas only; a name taken by a different shape gets a number appended.
    """
    out: dict[str, DataFrame] = {}
    for name, df in tables.items():
        base = name.rsplit("/", 1)[-1]
        same = next((k for k, other in out.items()
                     if k.split("__")[0] == base and jaccard(other.columns, df.columns) >= share), None)
        if same:
            out[same] = stack(out[same], df)
        else:
            key, n = base, 2
            while key in out:
                key, n = f"{base}__{n}", n + 1
            out[key] = df
    return out


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` does not have."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def distinct_by_priority(df: DataFrame, key: Sequence[str], score: str) -> DataFrame:
    """One row per key, the best score first (ties by the remaining columns)."""
    return keep_first(df.withColumn("__o", -F.col(score)), list(key), ["__o"]).drop("__o")


def replace_partition(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``old`` outside the partitions ``new`` brings, plus ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def merge_events(*events: DataFrame) -> DataFrame:
    """Events of several lists, one per (month, first 40 characters of the title); earlier lists win."""
    numbered = [e.withColumn("__o", F.lit(i)) for i, e in enumerate(events)]
    rows = stack(*numbered).withColumn("__m", F.trunc("date", "month")) \
        .withColumn("__t", F.substring(F.lower(F.trim("title")), 1, 40))
    return keep_first(rows, ["__m", "__t"], ["__o"]).drop("__o", "__m", "__t")
