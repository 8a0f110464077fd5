"""Archive of adverts to published aggregates, index, comparison and real index."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plinth.operators import archive as A
from plinth.operators import index as I
from plinth.operators.asof import quarter_end_rates
from plinth.session import measured


def archive_index(raw: DataFrame, daily_rates: DataFrame, today, cpi: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table of the archive; the published aggregates are materialised once."""
    rows = A.clean_archive(A.select_archive(raw))
    out = {name: measured(df) for name, df in A.published_tables(rows).items()}
    quarterly = out["quarterly"]
    rates = measured(quarter_end_rates(quarterly.select("quarter"), daily_rates, today))
    out["rates"] = rates
    out["index"] = I.index_series(quarterly, rates=rates)
    out["weights"] = I.fixed_weights(quarterly)
    last = I.last_quarters(quarterly)
    for market in ("Birlamchi", "Ikkilamchi"):
        out[f"comparison_{market}"] = I.comparison(quarterly.where(quarterly["market"] == market), "region_uz", last, rates)
    out["annual"] = I.annual_history(out["monthly"])
    out["partial"] = I.partial_periods(quarterly)
    if cpi is not None:
        out["real"] = I.real_index(I.som_index(out["index"]), I.price_level(cpi, quarterly.select("quarter")))
    return out
