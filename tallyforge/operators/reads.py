"""Reads of a state (key, value)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import key64


#: The most bytes that a side of a join may be estimated at to be sent to all executors.
SENT_TO_ALL = 24 << 20


def if_small(df: DataFrame) -> DataFrame:
    """Marks a side of a join for broadcast if its estimated size is within SENT_TO_ALL; else the join is a shuffle, whose
    hot keys Spark splits."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= SENT_TO_ALL else df


def point(state: DataFrame, key) -> DataFrame:
    """The row of one key, if it is there. A string is hashed for a state of 64-bit keys."""
    if isinstance(key, str) and dict(state.dtypes)["key"] != "string":
        return state.filter(F.col("key") == key64(F.lit(key)))
    return state.filter(F.col("key") == F.lit(key))


def counts_of(state: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) of each requested key, 0 where it is absent; repeated requests repeat."""
    return keys.join(if_small(state), "key", "left").select("key", F.coalesce("value", F.lit(0)).alias("value"))


def multi_get(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of requested keys that are there, repeated as the requests are, in any order."""
    return keys.select("key").join(if_small(state), "key")


def keys_only(state: DataFrame) -> DataFrame:
    return state.select("key")


def values_only(state: DataFrame) -> DataFrame:
    return state.select("value")


def where(state: DataFrame, predicate: Column) -> DataFrame:
    """A filter on key or value; a plain expression reaches the Parquet scan of a compacted store."""
    return state.filter(predicate)


def key_range(state: DataFrame, low: int, high: int) -> DataFrame:
    """low <= key < high."""
    return state.filter((F.col("key") >= low) & (F.col("key") < high))


def key_set(state: DataFrame, keys: DataFrame | Iterable) -> DataFrame:
    """Keys of a set: a few as an IN list, a table of them as a semi-join."""
    if isinstance(keys, DataFrame):
        return state.join(if_small(keys.select("key")), "key", "left_semi")
    return state.filter(F.col("key").isin(list(keys)))


def might_contain(state: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, present) of each request, exactly."""
    there = state.select("key").distinct().withColumn("__there", F.lit(True))
    return keys.select("key").join(if_small(there), "key", "left").select("key", F.coalesce("__there", F.lit(False)).alias("present"))


def exact_size(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("n"))


def approximate_size(log: DataFrame, error: float = 0.05) -> DataFrame:
    """Distinct keys of a log by HyperLogLog, without a fold."""
    return log.agg(F.approx_count_distinct("key", error).alias("n"))


def checksum(state: DataFrame) -> DataFrame:
    """A sum over rows of 28-bit hashes of key and value: it doesn't depend on order or storage, and what is added and removed
    leaves it as it was."""
    text = F.concat_ws("|", F.col("key").cast("string"), F.col("value").cast("string"))
    return state.agg(F.coalesce(F.sum(F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")), F.lit(0)).alias("checksum"))


def dump(state: DataFrame) -> DataFrame:
    """(key, json) of all rows."""
    return state.select("key", F.to_json(F.struct("value")).alias("json"))
