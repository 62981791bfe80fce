"""Folds: tombstones, order, every combinator, extreme keys."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import combinators as C
from tallyforge.operators.fold import fold, ordered_fold, python_fold

LOG = "key long, seq long, value {}"


def log(spark, rows, kind="long"):
    return spark.createDataFrame(rows, LOG.format(kind)).repartition(3)


def state(df):
    return {r[0]: r[1] for r in df.collect()}


def test_tombstone_resets(spark):
    rows = log(spark, [(1, 0, 5), (1, 1, None), (1, 2, 3), (2, 0, 5), (2, 1, None), (3, 0, 7)])
    assert state(fold(rows, C.LONG)) == {1: 3, 3: 7}
    assert state(fold(rows, C.OVERWRITE)) == {1: 3, 3: 7}
    assert state(ordered_fold(rows, F.lit(None).cast("long"), lambda a, b: a + b)) == {1: 3, 3: 7}
    assert state(python_fold(rows, lambda a, b: a + b, "long")) == {1: 3, 3: 7}


def test_counts_delete_even(spark):
    rows = [(i, 0, 1) for i in range(100)] + [(i, 1, None) for i in range(0, 100, 2)]
    assert state(fold(log(spark, rows), C.LONG)) == {i: 1 for i in range(1, 100, 2)}


def test_extreme_keys_and_overflow(spark):
    keys = [-1, 0, -(2**63), 2**63 - 1, 2**63 - 2]
    assert state(fold(log(spark, [(k, 0, 2) for k in keys]), C.LONG)) == dict.fromkeys(keys, 2)
    with pytest.raises(Exception, match="OVERFLOW"):
        fold(log(spark, [(1, 0, 2**63 - 1), (1, 1, 1)]), C.LONG).collect()
    assert state(fold(log(spark, [(1, 0, 2**63 - 1), (1, 1, 1)]), C.LONG_TRY)) == {}


def test_numbers(spark):
    assert state(fold(log(spark, [(1, 0, 2), (1, 1, 3)], "int"), C.INTEGER)) == {1: 5}
    assert state(fold(log(spark, [(1, 0, 0.5), (1, 1, 0.25)], "float"), C.FLOAT)) == {1: 0.75}
    assert state(fold(log(spark, [(1, 0, 0.5), (1, 1, 0.25)], "double"), C.DOUBLE)) == {1: 0.75}


def test_null_is_not_the_string(spark):
    rows = log(spark, [(1, 0, "null"), (2, 0, "a"), (2, 1, None), (3, 0, None), (3, 1, "é")], "string")
    assert state(fold(rows, C.OVERWRITE)) == {1: "null", 3: "é"}


def test_maps_and_lists(spark):
    maps = log(spark, [(1, 0, {"a": 1}), (1, 1, {"a": 2, "b": 5})], "map<string,long>")
    assert state(fold(maps, C.COUNT_MAP)) == {1: {"a": 3, "b": 5}}
    pairs = log(spark, [(1, 0, [(2, 1), (1, 1)]), (1, 1, [(2, 4)])], "array<struct<k:long,n:long>>")
    assert [tuple(x) for x in state(fold(pairs, C.COUNTS_LIST))[1]] == [(1, 1), (2, 5)]
    longs = log(spark, [(1, 0, [3, 1, 3]), (1, 1, [2])], "array<long>")
    assert state(fold(longs, C.LONG_LIST)) == {1: [1, 2, 3]}
    strings = log(spark, [(1, 0, ["b"]), (1, 1, ["a", "b"])], "array<string>")
    assert state(fold(strings, C.STRING_SET)) == {1: ["a", "b"]}
    assert state(fold(longs, C.POSTINGS)) == {1: [3, 1, 3, 2]}


def test_list_merge_takes_the_second_after_null(spark):
    rows = log(spark, [(1, 0, [(7, 5), (8, 1)]), (1, 1, [(7, None)]), (1, 2, [(7, 2)])], "array<struct<k:long,v:long>>")
    assert [tuple(x) for x in state(fold(rows, C.list_merge(C.LONG)))[1]] == [(7, 2), (8, 1)]


def test_objects(spark):
    kind = "struct<id:string,first:string,last:string>"
    rows = log(spark, [(1, 0, ("u1", "Ada", None)), (1, 1, ("u1", None, "L")), (1, 2, ("u1", "Grace", "")), (1, 3, ("other", "X", "Y"))], kind)
    assert {k: tuple(v) for k, v in state(fold(rows, C.by_id(C.last_non_empty(["first", "last"])))).items()} == {"u1": ("Grace", "L"), "other": ("X", "Y")}
    counts = log(spark, [(5, 0, (5, 1)), (5, 1, (5, 2))], "struct<k:long,n:long>")
    assert tuple(state(fold(counts, C.KEYED_COUNT))[5]) == (5, 3)


def test_unique_first(spark):
    rows = spark.createDataFrame([(2, 0, "a", 1), (2, 1, "b", 1)], "key long, seq long, value string, primary long")
    assert state(fold(rows, C.unique_first())) == {2: "a"}
    with pytest.raises(Exception, match="not unique"):
        fold(rows.unionByName(spark.createDataFrame([(2, 2, "c", 9)], rows.schema)), C.unique_first()).collect()


def test_empty(spark):
    assert state(fold(log(spark, []), C.LONG)) == {} == state(fold(log(spark, []), C.OVERWRITE))
