"""Category values in another language: distinct values are translated once and joined back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.session import measured

# Endings that give Latin-script Uzbek away.
SUFFIXES = r"(lik|lar|ning|dan|ga|da|siz|chi|cha)$"


def needs_translation(text: Column, dictionary: Mapping[str, str]) -> Column:
    """Cyrillic letters, a dictionary hit or a telling suffix."""
    hit = F.lower(text).isin(list(dictionary)) if dictionary else F.lit(False)
    return text.rlike(r"\p{IsCyrillic}") | hit | F.lower(text).rlike(SUFFIXES)


def translated(text: Column, dictionary: Mapping[str, str]) -> Column:
    """(text, resolved): the whole phrase if known, else word by word with its capital kept."""
    entries = F.create_map(*[F.lit(x) for kv in dictionary.items() for x in kv])
    whole = F.try_element_at(entries, F.lower(F.trim(text)))
    words = F.split(F.trim(text), r"\s+")
    one = lambda w: F.try_element_at(entries, F.lower(w))
    capital = lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}")
    shape = lambda w, t: F.when(capital(w), F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))).otherwise(t)
    each = F.transform(words, lambda w: F.coalesce(shape(w, one(w)), w))
    known = F.forall(words, lambda w: one(w).isNotNull())
    return F.struct(F.coalesce(shape(text, whole), F.array_join(each, " ")).alias("text"),
                    (whole.isNotNull() | known).alias("resolved"))


def translate_column(df: DataFrame, column: str, dictionary: Mapping[str, str]) -> DataFrame:
    """Replace ``column`` by its translation; ``<column>_resolved`` tells whether all of it was known."""
    values = measured(df.select(column).where(F.col(column).isNotNull()).distinct()
                      .withColumn("__t", translated(F.col(column), dictionary)))
    return df.join(values, column, "left").withColumn(column, F.coalesce("__t.text", column)) \
        .withColumn(f"{column}_resolved", F.col("__t.resolved")).drop("__t")
