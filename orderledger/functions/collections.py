"""Name lists and string maps, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def normalize_names(names: Column) -> Column:
    """Strip every name, drop blanks, keep the first of each; null gives an empty list."""
    listed = F.coalesce(names, F.array().cast("array<string>"))
    stripped = F.transform(listed, strip)
    return F.array_distinct(F.filter(stripped, lambda name: name != F.lit("")))


def append_names(names: Column, more: Column) -> Column:
    """``names`` followed by the new ones among ``more``, both normalised."""
    return F.array_distinct(F.concat(normalize_names(names), normalize_names(more)))


def merge_maps(first: Column, second: Column) -> Column:
    """Both maps in one; on a shared key the second wins. Null counts as empty.

    map_concat() refuses shared keys unless the session says otherwise, so they
    are taken out of the first map.
    """
    empty = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(first, empty), F.coalesce(second, empty)
    kept = F.map_filter(left, lambda key, value: ~F.map_contains_key(right, key))
    return F.map_concat(kept, right)
