"""Registration of a Spark query with its (optional) oracle SQL.

Floating results are rounded on both sides in the same way: the order of a distributed
sum is not fixed, so the last bits of a double are not part of a result.  ``OFF_TIE``
keeps means of cents, which often end exactly on half a unit, from falling either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFF_TIE = 0.0000017

QUERIES: dict = {}
ORACLES: dict = {}


def round_columns(df: DataFrame, names, digits: int) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + F.lit(OFF_TIE), digits) + F.lit(0.0) for n in names}) if names else df


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 4):
    """Register ``fn(spark, sf_dir)``; ``doubles`` lists the columns to round."""
    names = doubles.split()

    def register(fn):
        def run(spark, sf_dir):
            return round_columns(fn(spark, sf_dir), names, digits)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip().rstrip(";")
            if names:
                parts = ", ".join(f"round({n} + {OFF_TIE:.7f}, {digits}) + 0.0 AS {n}" for n in names)
                body = f"SELECT * REPLACE ({parts}) FROM ({body}) AS q"
            ORACLES[name] = body
        return fn

    return register
