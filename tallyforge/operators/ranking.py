"""Lists of counts: total, lookup, order, and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(counts: Column) -> Column:
    return F.aggregate(F.transform(counts, lambda c: c["n"]), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def total_double(counts: Column) -> Column:
    return F.aggregate(F.transform(counts, lambda c: c["n"].cast("double")), F.lit(0.0), lambda a, x: a + x)


def count_of(counts: Column, key) -> Column:
    """The count of one key, 0 if it isn't there."""
    return F.coalesce(F.get(F.transform(F.filter(counts, lambda c: c["k"] == key), lambda c: c["n"]), 0), F.lit(0))


def sorted_keys(counts: Column) -> Column:
    """Keys by count descending, then key ascending."""
    return F.transform(F.array_sort(F.transform(counts, lambda c: F.struct((-c["n"]).alias("m"), c["k"].alias("k")))), lambda c: c["k"])


def compact(keys: Column) -> Column:
    return F.array_sort(F.array_distinct(keys))


def ranked(rows: DataFrame, key: str, count: str, top: int | None = None) -> DataFrame:
    """Rows by count descending, then key: an ordered result, or its first ``top`` rows without a full sort."""
    out = rows.orderBy(F.desc(count), key)
    return out.limit(top) if top is not None else out
