"""Spanish order and search by collations: ñ is a letter of its own after n, accents and case don't count in a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spanish rules; the second one without accents and case. ñ differs from n in both.
ORDER, SEARCH = "es", "es_CI_AI"


def matches(text: Column, wanted: str) -> Column:
    """Whether a text holds the wanted words as they stand; nothing wanted is in every text, and in null there is nothing."""
    part = wanted.strip()
    return text.isNotNull() if not part else F.contains(F.collate(text, SEARCH), F.collate(F.lit(part), SEARCH))


def spanish_order(term: Column, key: Column) -> list[Column]:
    """Columns to sort by: the term without accents and case, then its accents and case, then the key."""
    return [F.asc_nulls_last(F.collate(term, SEARCH)), F.asc_nulls_last(F.collate(term, ORDER)), key]


def search_glossary(entries: DataFrame, wanted: str, category: str | None = None) -> DataFrame:
    """Entries (id, term, category, short, full) that hold the wanted words in any of their texts, of one category or of all."""
    texts = [F.coalesce(c, F.lit("")) for c in ("term", "short", "full", "category")]
    found = entries.where(matches(F.concat_ws(" ", *texts), wanted))
    return found if category is None else found.where(F.collate("category", SEARCH) == F.collate(F.lit(category), SEARCH))


def in_order(entries: DataFrame, first: int | None = None) -> DataFrame:
    """Entries in Spanish order of their terms; the first ones of them, if asked, which are found by partial sorts."""
    found = entries.orderBy(*spanish_order(F.col("term"), F.col("id")))
    return found if first is None else found.limit(first)
