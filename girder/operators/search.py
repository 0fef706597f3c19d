"""Searches over several fields, taxonomies and enumerations."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.semantics import any_contains


def multi_field_search(rows: DataFrame, predicate: Column | str, fields: Sequence[str], order: Sequence[str], limit: int = 60) -> DataFrame:
    """The first rows, in order, of which some field holds the query (or a predicate of one's own)."""
    found = any_contains(predicate, *[F.col(f) for f in fields]) if isinstance(predicate, str) else predicate
    return rows.filter(found).orderBy(*order).limit(limit)


def enum_search(rows: DataFrame, query: str, number: str, names: Sequence[str], order: Sequence[str], limit: int = 50) -> DataFrame:
    """A whole number finds its value exactly, other queries find names; an empty query finds nothing."""
    text = query.strip()
    if not text:
        return rows.filter(F.lit(False))
    found = F.col(number) == int(text) if re.fullmatch(r"-?\d+", text) else any_contains(text, *[F.col(n) for n in names])
    return rows.filter(found).orderBy(*order).limit(limit)


def taxonomy_search(rows: DataFrame, query: str, fields: Sequence[str], order: Sequence[str], limit: int = 60) -> DataFrame:
    """Like multi_field_search, but an empty query finds nothing."""
    return multi_field_search(rows, query, fields, order, limit) if query.strip() else rows.filter(F.lit(False))


def taxonomy_lookup(elements: DataFrame, taxonomy: DataFrame, element: str, names: str, values: str, wanted: str = "omniclassnumber") -> DataFrame:
    """(element, number, title): the first parameter of that name (letters and digits, any case) looked up in the taxonomy (number, title)."""
    pairs = F.arrays_zip(F.col(names).alias("name"), F.col(values).alias("value"))
    first = F.try_element_at(F.filter(pairs, lambda p: F.regexp_replace(F.lower(p["name"]), "[^a-z0-9]", "") == wanted), F.lit(1))["value"]
    numbered = elements.select(element, first.alias("number")).filter("number is not null")
    items = taxonomy.groupBy("number").agg(F.min("title").alias("title"))
    return numbered.join(items, "number").select(element, "number", "title")


def hidden_elements(rows: DataFrame, element: str, category: str, hidden: DataFrame, level: DataFrame | None = None) -> DataFrame:
    """Rows whose category is hidden, or that aren't on the isolated level (ids of one column), if one is given."""
    out = rows.join(hidden.select(F.col(hidden.columns[0]).alias(category)), category, "left_semi")
    if level is None:
        return out.select(*rows.columns)
    off = rows.join(level.select(F.col(level.columns[0]).alias(element)), element, "left_anti")
    return out.select(*rows.columns).unionByName(off.select(*rows.columns)).distinct()
