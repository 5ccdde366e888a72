"""Ordered aggregates, filters and zips over arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_distinct(order: str, value: str) -> Column:
    """Distinct values in the order of their first occurrence, as an aggregate."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]))


def concatenated(order: str, array: str) -> Column:
    """Arrays one after another in order, as an aggregate."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, array))), lambda x: x[array]))


def first_non_empty(value: str, order: str) -> Column:
    """The first array with an entry, or text with a character, as an aggregate."""
    has = F.coalesce(F.length(F.col(value).cast("string")) > 0, F.lit(False))
    return F.min_by(F.when(has, F.col(value)), F.when(has, F.col(order)))


def united_maps(rows: DataFrame, by: list[str], order: str, entries: str) -> DataFrame:
    """(*by, entries): the maps of a group as one, the last value of each key."""
    flat = rows.select(*by, order, F.explode(entries).alias("_k", "_v")).groupBy(*by, "_k").agg(F.max_by("_v", order).alias("_v"))
    return flat.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(entries))


def filled(base: Column, more: Column) -> Column:
    """``base`` with the entries of ``more`` whose keys it lacks."""
    return F.map_concat(F.map_filter(more, lambda k, _: ~F.map_contains_key(base, k)), base)


def without(entries: Column, *keys: str) -> Column:
    return F.map_filter(entries, lambda k, _: ~k.isin(*keys))


def zipped(a: Column, b: Column) -> Column:
    """Pairs by place; arrays of different lengths stop the query."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("a"), b.alias("b"))).otherwise(F.raise_error(F.lit("lengths differ")).cast("array<struct<a:string,b:string>>"))


def has_method(evidence: Column, method: str) -> Column:
    return F.exists(evidence, lambda e: e["method"] == method)


def open_issues(status: Column, value: Column) -> Column:
    """What a reviewer wants to see: nothing read, or readings in conflict."""
    return value.isNull() | (status == "conflict")


def matches_search(text: Column, words: str) -> Column:
    return F.lower(text).contains(words.lower())


def positive_ids(ids: list[int]) -> list[int]:
    if bad := [i for i in ids if isinstance(i, bool) or i <= 0]:
        raise ValueError(f"ids must be positive: {bad}")
    return ids


def peers(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(key, peer): other rows of the same group, for groups of the size of one entity's visits."""
    a, b = rows.select(group, key), rows.select(group, F.col(key).alias("peer"))
    return a.join(b, group).where(F.col(key) != F.col("peer")).select(key, "peer")
