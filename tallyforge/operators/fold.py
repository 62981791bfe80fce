"""The fold of a log (key, seq, value) into a state (key, value).

Values of a key are taken by ``seq``. A null value is a tombstone: it forgets what came before, and a key that ends with one is absent.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .combinators import Combinator


def survivors(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The rows after each key's last tombstone.

    Only tombstones are grouped and joined back, so that the sums that follow keep their map-side part and a hot key is
    not sorted as a window would; where tombstones are few, the join is a broadcast that Spark picks by their size.
    """
    keys = keys or ["key"]
    last = log.filter("value is null").groupBy(*keys).agg(F.max("seq").alias("__reset"))
    kept = log.filter("value is not null").join(last, keys, "left")
    return kept.filter("__reset is null or seq > __reset").drop("__reset")


def fold(log: DataFrame, combinator: Combinator, tombstones: bool = True) -> DataFrame:
    """(key, value): the state of the log. ``tombstones=False`` promises that no value is null and saves a join."""
    if tombstones and not combinator.sees_tombstones:
        log = survivors(log)
    return combinator.state(log)


def ordered_fold(log: DataFrame, start: Column, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """Any fold that Column expressions can say, tombstones included, in the order of seq; also on a stream. It gathers
    the values of a key in one row: for keys of bounded history."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "value")))

    def step(a: Column, x: Column) -> Column:
        return F.when(a.isNull() | x["value"].isNull(), x["value"]).otherwise(merge(a, x["value"]))

    return log.groupBy("key").agg(F.aggregate(listed, start, step).alias("value")).filter("value is not null")


def python_fold(log: DataFrame, combine: Callable, value_type: str | T.DataType) -> DataFrame:
    """A fold by an associative Python function of two values.

    It gathers a key's history in one task: for combinators that no built-in aggregate can say, and keys of bounded history.
    """
    kind = value_type if isinstance(value_type, str) else value_type.simpleString()
    schema = f"key {log.schema['key'].dataType.simpleString()}, seq {log.schema['seq'].dataType.simpleString()}, value {kind}"

    def state(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        value = None
        for v in pdf["value"]:
            missing = v is None or v is pd.NaT or isinstance(v, float) and pd.isna(v)
            value = None if missing else v if value is None else combine(value, v)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "seq": [pdf["seq"].iloc[-1]], "value": pd.Series([value], dtype=object)})

    return log.select("key", "seq", "value").groupBy("key").applyInPandas(state, schema).select("key", "value").filter("value is not null")
