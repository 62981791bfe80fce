"""How two values of a key become one. Each combinator builds the state of a log whose tombstones are dealt with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Combinator:
    """``state`` maps (key, seq, value) to (key, value). ``sees_tombstones``: it handles null values itself.
    ``closed``: a state's rows may stand in a log for all that they were folded from."""

    name: str
    state: Callable[[DataFrame], DataFrame]
    sees_tombstones: bool = False
    closed: bool = True


def by_aggregate(name: str, agg: Callable[[], Column], sees_tombstones: bool = False) -> Combinator:
    return Combinator(name, lambda log: log.groupBy("key").agg(agg().alias("value")).filter("value is not null"), sees_tombstones)


#: Sums. A sum beyond its type is an error; LONG_TRY gives null instead.
LONG = by_aggregate("long", lambda: F.sum(F.col("value").cast("long")))
LONG_TRY = by_aggregate("long_try", lambda: F.try_sum(F.col("value").cast("long")))
INTEGER = by_aggregate("integer", lambda: F.sum(F.col("value").cast("long")).cast("int"))
FLOAT = by_aggregate("float", lambda: F.sum(F.col("value").cast("double")).cast("float"))
DOUBLE = by_aggregate("double", lambda: F.sum(F.col("value").cast("double")))
#: The last write wins. A final tombstone gives null, which drops the key.
OVERWRITE = by_aggregate("overwrite", lambda: F.max_by("value", "seq"), True)


def _entries(log: DataFrame, value: Callable[[], Column]) -> DataFrame:
    return log.groupBy("key").agg(value().alias("value"))


def _count_map(log: DataFrame) -> DataFrame:
    long = log.select("key", F.explode("value").alias("k", "n")).groupBy("key", "k").agg(F.sum("n").alias("n"))
    return _entries(long, lambda: F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))))


#: Maps to counts, added entry by entry. Entries are summed in long form before one row holds them.
COUNT_MAP = Combinator("count_map", _count_map)


def counts_list(log: DataFrame) -> DataFrame:
    """Lists of (k, n) sorted by k, equal k added; n long or double."""
    long = log.select("key", F.explode("value").alias("e")).groupBy("key", F.col("e.k").alias("k")).agg(F.sum("e.n").alias("n"))
    return _entries(long, lambda: F.sort_array(F.collect_list(F.struct("k", "n"))))


COUNTS_LIST = Combinator("counts_list", counts_list)


def _union(log: DataFrame) -> DataFrame:
    items = log.select("key", F.explode("value").alias("x")).distinct()
    return _entries(items, lambda: F.sort_array(F.collect_list("x")))


#: Sorted distinct union of arrays. Items are made distinct in long form, so a hot key's repeats are gone before it is gathered.
LONG_LIST = Combinator("long_list", _union)
STRING_SET = Combinator("string_set", _union)


def _postings(log: DataFrame) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("seq", "value")))
    return _entries(log, lambda: F.flatten(F.transform(listed, lambda x: x["value"])))


#: Arrays put one after the other in the order of seq, repeats kept.
POSTINGS = Combinator("postings", _postings)


def list_merge(inner: Combinator) -> Combinator:
    """Lists of (k, v) merged by k: values of equal k are combined by ``inner``; after a null value the next one counts alone."""
    from .fold import survivors

    def state(log: DataFrame) -> DataFrame:
        long = log.select("key", "seq", F.explode("value").alias("e")).select(F.struct("key", F.col("e.k").alias("k")).alias("key"), "seq", F.col("e.v").alias("value"))
        kept = inner.state(long if inner.sees_tombstones else survivors(long))
        every = long.select("key").distinct().join(kept, "key", "left").select(F.col("key.key").alias("key"), F.col("key.k").alias("k"), F.col("value").alias("v"))
        return _entries(every, lambda: F.sort_array(F.collect_list(F.struct("k", "v"))))

    return Combinator(f"list_merge({inner.name})", state, closed=inner.closed)


def by_id(inner: Combinator, id_field: str = "id") -> Combinator:
    """Objects that carry their own string id: each id is folded by ``inner``, whatever hash key it shares."""

    def state(log: DataFrame) -> DataFrame:
        own = log.select(F.col(f"value.{id_field}").alias("key"), "seq", "value")
        return inner.state(own)

    return Combinator(f"by_id({inner.name})", state, closed=False)


def ids(inner: Combinator) -> Combinator:
    """Objects (id, body) under the hash of their id: each id is folded by ``inner`` on its own; a null body removes it."""
    from .fold import fold

    def state(log: DataFrame) -> DataFrame:
        own = log.select(F.struct("key", F.col("value.id").alias("id")).alias("key"), "seq", F.col("value.body").alias("value"))
        return fold(own, inner).select(F.col("key.key").alias("key"), F.struct(F.col("key.id").alias("id"), F.col("value").alias("body")).alias("value"))

    return Combinator(f"ids({inner.name})", state, True, inner.closed)


#: The different values of a key, a row for each.
ENTRIES = Combinator("entries", lambda log: log.select("key", "value").distinct(), True)


def last_non_empty(fields: list[str]) -> Combinator:
    """Objects merged field by field: the last value that is neither null nor an empty string."""

    def agg() -> Column:
        def last(f: str) -> Column:
            v = F.col(f"value.{f}")
            filled = v.isNotNull() & (v.cast("string") != "")
            return F.max_by(F.when(filled, v), F.when(filled, F.col("seq")))

        return F.struct(*[last(f).alias(f) for f in fields])

    return by_aggregate("last_non_empty", agg)


def unique_first(primary: str = "primary") -> Combinator:
    """The first value of a key; it is an error if values of two ``primary`` keys meet."""

    def state(log: DataFrame) -> DataFrame:
        p = F.col(primary)
        found = log.groupBy("key").agg(F.min_by("value", "seq").alias("value"), F.min(p).alias("low"), F.max(p).alias("high"))
        checked = F.when(F.col("low") != F.col("high"), F.raise_error(F.concat(F.lit("key is not unique: "), F.col("key").cast("string")))).otherwise(F.col("value"))
        return found.select("key", checked.alias("value"))

    return Combinator("unique_first", state, closed=False)


def _keyed_count(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.struct(F.min("value.k").alias("k"), F.sum("value.n").alias("n")).alias("value"))


#: Objects (k, n) whose counts are added.
KEYED_COUNT = Combinator("keyed_count", _keyed_count)


def compact_index(features: int) -> Combinator:
    """Sets of longs, exact as an array while they have fewer than features / 10 members, beyond that a bloom filter of 1 %."""
    from .sketches import hybrid_sets

    return Combinator("compact_index", lambda log: hybrid_sets(log, features), closed=False)


def compact_counts(most: int) -> Combinator:
    """Lists of (k, n), exact while they have fewer than most / 10 keys, beyond that counting filters."""
    from .sketches import hybrid_counts

    return Combinator("compact_counts", lambda log: hybrid_counts(log, most), closed=False)


def custom(name: str, state: Callable[[DataFrame], DataFrame], closed: bool = False) -> Combinator:
    """A user's own."""
    return Combinator(name, state, True, closed)


BY_NAME = {c.name: c for c in (LONG, LONG_TRY, INTEGER, FLOAT, DOUBLE, OVERWRITE, COUNT_MAP, COUNTS_LIST, LONG_LIST, STRING_SET, POSTINGS, KEYED_COUNT)}
