"""Secondary indexes on a state. An index is a function of the current state: an overwritten value leaves no posting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Indexer = Callable[[Column], Column]


def multi_index(state: DataFrame, indexer: Indexer) -> DataFrame:
    """(ikey, key): a row for each distinct index key of each value. ``indexer`` gives an array. Values stay where they are."""
    return state.select(F.explode(F.array_distinct(indexer(F.col("value")))).alias("ikey"), "key")


def postings(state: DataFrame, indexer: Indexer, ikey) -> DataFrame:
    """(key, value) of the rows with an index key, by one pass over the state."""
    return state.filter(F.array_contains(indexer(F.col("value")), F.lit(ikey))).select("key", "value")


def by_example(state: DataFrame, indexer: Indexer, example) -> DataFrame:
    """The rows that share any index key with the example, each once."""
    return state.filter(F.arrays_overlap(indexer(F.col("value")), indexer(F.lit(example)))).select("key", "value")


def by_index_key(state: DataFrame, indexer: Indexer, predicate: Callable[[Column], Column]) -> DataFrame:
    """The rows with an index key that passes, each once."""
    return state.filter(F.exists(indexer(F.col("value")), predicate)).select("key", "value")


def unique_index(state: DataFrame, indexer: Indexer) -> DataFrame:
    """(ikey, key, value), one row for each index key; it is an error if two keys share one."""
    rows = state.select(indexer(F.col("value")).alias("ikey"), "key", "value")
    found = rows.groupBy("ikey").agg(F.count("*").alias("n"), F.min(F.struct("key", "value")).alias("r"))
    key = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("index key is not unique: "), F.col("ikey").cast("string")))).otherwise(F.col("r.key"))
    return found.select("ikey", key.alias("key"), F.col("r.value").alias("value"))


def inverted(documents: DataFrame, tokens: Column) -> DataFrame:
    """(token, doc, offset) from (key, value), a row for each token of each text: a common token fills no row or task."""
    return documents.select(F.col("key").alias("doc"), F.posexplode(tokens).alias("offset", "token")).select("token", "doc", "offset")


def write_inverted(rows: DataFrame, path: str) -> None:
    """Stores an inverted index in the order of token, document and offset, so that a filter on token reads few row groups."""
    rows.repartitionByRange("token", "doc").sortWithinPartitions("token", "doc", "offset").write.mode("overwrite").parquet(path)


def gathered(rows: DataFrame) -> DataFrame:
    """(token, postings): the (doc, offset) of each token in one row, for the few tokens that were asked for."""
    return rows.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("doc", "offset"))).alias("postings"))
