"""A snapshot of two sources to the bulletin tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import cross_section as X
from plinth.operators import listings as L
from plinth.operators import quality as Q


def bulletin(adverts: DataFrame, second: DataFrame, rate: float = L.DEFAULT_RATE) -> dict[str, DataFrame]:
    """Pooled listings, audit, regional and district medians, yields, source mix.

    ``adverts`` are nested adverts with ``collection_category``; ``second`` the other
    site's rows in their raw shape.
    """
    first = L.advert_rows(adverts).withColumn("source", F.lit("first"))
    pooled, counts = L.pool(first, L.second_source_rows(second), rate)
    clean, findings = Q.audit(pooled)
    known = clean.where("place_ok")
    capital = clean.where(clean["district"] != L.UNKNOWN)
    yields = X.rental_yield(known, ["region", "property", "rooms"])
    screened = Q.screen_yields(yields)
    return {
        "listings": clean, "counts": counts, "findings": findings,
        "sale_regions": X.table_medians(known.where("kind = 'sale'"), ["region", "property"], "sqm_uzs", 1e6),
        "rent_regions": X.table_medians(known.where("kind = 'rent'"), ["region", "property"], "sqm_uzs", 1e3),
        "sale_districts": X.table_medians(capital.where("kind = 'sale'"), ["district", "property"], "sqm_uzs", 1e6),
        "yields": screened.where("plausible"), "yields_held_back": screened.where("NOT plausible"),
        "source_mix": X.source_mix(clean),
    }
