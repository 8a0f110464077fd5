"""Cleaning of tables whose schema is not known beforehand.

Names and decisions come from the schema and from one aggregate over the whole column,
never from the first rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

# Fixed value: share of the texts that must parse for a column to become numeric.
NUMERIC_SHARE = 0.9


def safe_name(name: str) -> str:
    """Word characters only, single underscores, lower case; any alphabet is kept."""
    return re.sub(r"_+", "_", re.sub(r"\W", "_", str(name).strip())).strip("_").lower() or "column"


def safe_columns(df: DataFrame) -> DataFrame:
    """Safe, unique column names; a repeated name gets its count appended."""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        name = safe_name(column)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def drop_empty(df: DataFrame) -> DataFrame:
    """Without all-null rows, then without all-null columns (one counting pass)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    kept = [c for i, c in enumerate(df.columns) if counts[i]]
    return df.na.drop("all").select(*[F.col(f"`{c}`") for c in kept])


def explode_parallel_arrays(df: DataFrame) -> DataFrame:
    """Two or more list columns of equal length in every row become rows, otherwise nothing changes.

    A row whose lists are empty or missing stays as one row of NULLs; lists of lists abort.
    """
    arrays = [f for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    if len(arrays) < 2 or any(isinstance(f.dataType.elementType, ArrayType) for f in arrays):
        return df
    names = [f.name for f in arrays]
    sizes = [F.coalesce(F.size(F.col(f"`{n}`")), F.lit(-1)) for n in names]
    agree = sizes[0] == sizes[1]
    for s in sizes[2:]:
        agree = agree & (sizes[0] == s)
    if not df.agg(F.bool_and(agree)).first()[0]:
        return df
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    zipped = F.arrays_zip(*[F.col(f"`{n}`") for n in names])
    return df.select(*rest, F.explode_outer(zipped).alias("__z")).select(
        *rest, *[F.col(f"__z.`{n}`").alias(n) for n in names])


def containers_to_json(df: DataFrame) -> DataFrame:
    """Struct, map and array cells as JSON text."""
    return df.select(*[
        F.to_json(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, (StructType, MapType, ArrayType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def number_text(x: Column, thousands: str = "") -> Column:
    """'$1 234,5' -> 1234.5; the comma is a decimal point unless named as thousands mark."""
    text = F.regexp_replace(F.trim(x), r"[\s %$" + re.escape(thousands) + "]", "")
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def coerce_numeric_text(df: DataFrame, thousands: str = "", columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns of which nine tenths parse as numbers become doubles."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)
             and (columns is None or f.name in columns)]
    if not texts:
        return df
    share = lambda c: F.try_divide(F.count(number_text(F.col(f"`{c}`"), thousands)), F.count(F.col(f"`{c}`")))
    shares = df.agg(*[share(c).alias(f"s{i}") for i, c in enumerate(texts)]).first()
    numeric = {c for i, c in enumerate(texts) if shares[i] is not None and shares[i] >= NUMERIC_SHARE}
    return df.select(*[number_text(F.col(f"`{c}`"), thousands).alias(c) if c in numeric else F.col(f"`{c}`")
                       for c in df.columns])


def cleaned(df: DataFrame) -> DataFrame:
    """The whole cleaning chain in its fixed order."""
    return coerce_numeric_text(containers_to_json(explode_parallel_arrays(drop_empty(safe_columns(df)))))
