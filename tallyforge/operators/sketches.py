"""Bloom filters, counting filters and sets that turn into them, as tables of bits that merge by key."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import probes


@dataclass(frozen=True)
class Size:
    """Of a filter: its bits, a multiple of 64, and its number of hashes."""

    bits: int
    hashes: int

    @classmethod
    def of(cls, n: int, fpp: float) -> Size:
        """For ``n`` members and a share ``fpp`` of false positives: -n ln(fpp) / ln(2)**2 bits, ln(2) times the bits of a member as hashes."""
        if n < 1 or not 0 < fpp < 1:
            raise ValueError("a filter needs a member or more, and a share of false positives between 0 and 1")
        bits = -n * math.log(fpp) / math.log(2) ** 2
        return cls(64 * math.ceil(bits / 64), max(1, round(bits / n * math.log(2))))


def bits_of(keys: DataFrame, size: Size) -> DataFrame:
    """(bit) set by the column key of ``keys``, each once."""
    return keys.select(F.explode(probes(F.col("key"), size.hashes, size.bits)).alias("bit")).distinct()


def words_of(bits: DataFrame) -> DataFrame:
    """(word, mask): a filter as 64-bit words, the form to store or merge by bit_or."""
    return bits.groupBy(F.floor(F.col("bit") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))


def merge_words(*filters: DataFrame) -> DataFrame:
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy("word").agg(F.bit_or("mask").alias("mask"))


def merge_bits(*filters: DataFrame) -> DataFrame:
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.distinct()


def might_contain(bits: DataFrame, keys: DataFrame, size: Size) -> DataFrame:
    """(key, present) of the distinct requested keys: present if all its bits are set. No present key is missed."""
    asked = keys.select("key").distinct().select("key", F.explode(F.array_distinct(probes(F.col("key"), size.hashes, size.bits))).alias("bit"))
    hit = asked.join(bits.withColumn("__set", F.lit(1)), "bit", "left")
    return hit.groupBy("key").agg((F.count("__set") == F.count("*")).alias("present"))


def expected_fpp(bits: DataFrame, size: Size) -> DataFrame:
    return bits.agg(F.pow(F.count("*") / F.lit(float(size.bits)), F.lit(float(size.hashes))).alias("fpp"))


def with_check_sum(words: DataFrame, size: Size, check_sum: str) -> DataFrame:
    """(check_sum, hashes, bits, word, mask): a filter as it is stored, with what it needs to be read."""
    return words.select(F.lit(check_sum).alias("check_sum"), F.lit(size.hashes).alias("hashes"), F.lit(size.bits).cast("long").alias("bits"), "word", "mask")


def _size_of(words: DataFrame) -> Size | None:
    found = words.select("hashes", "bits").head(1)
    return Size(found[0]["bits"], found[0]["hashes"]) if found else None


def words_fpp(words: DataFrame) -> DataFrame:
    """(fpp): the expected share of false positives of a stored filter."""
    return words.agg(F.pow(F.sum(F.bit_count("mask")) / F.max("bits"), F.max("hashes")).alias("fpp"))


def words_contain(words: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, present) of the distinct requested keys by a stored filter."""
    size = _size_of(words)
    asked = keys.select("key").distinct()
    if size is None:
        return asked.select("key", F.lit(False).alias("present"))
    at = asked.select("key", F.explode(F.array_distinct(probes(F.col("key"), size.hashes, size.bits))).alias("bit"))
    at = at.withColumn("word", F.floor(F.col("bit") / 64).cast("long")).join(words.select("word", "mask"), "word", "left")
    is_set = F.call_function("getbit", F.coalesce("mask", F.lit(0).cast("long")), (F.col("bit") % 64).cast("int")) == 1
    return at.groupBy("key").agg(F.bool_and(is_set).alias("present"))


def cells_of(counted: DataFrame, size: Size, most: int = 255, conservative: bool = True) -> DataFrame:
    """(cell, n) of a counting filter for (key, n), a row for each key; counts saturate at ``most``.

    A conservative filter raises a cell no further than its keys need: as each key comes with its whole count, a cell
    holds the largest count of its keys, not their sum. Either way no estimate is too low, nor is one after a merge by sum.
    """
    at = counted.select(F.explode(F.array_distinct(probes(F.col("key"), size.hashes, size.bits))).alias("cell"), "n")
    n = F.max("n") if conservative else F.sum("n")
    return at.groupBy("cell").agg(F.least(n, F.lit(most)).cast("long").alias("n"))


def cells_fpp(cells: DataFrame, size: Size) -> DataFrame:
    """(fpp): the expected share of keys never counted that get a count."""
    return cells.agg(F.pow(F.count("*") / F.lit(float(size.bits)), F.lit(float(size.hashes))).alias("fpp"))


def merge_cells(a: DataFrame, b: DataFrame, most: int = 255) -> DataFrame:
    return a.unionByName(b).groupBy("cell").agg(F.least(F.sum("n"), F.lit(most)).cast("long").alias("n"))


def max_count(cells: DataFrame, keys: DataFrame, size: Size) -> DataFrame:
    """(key, n): the least of a key's cells, 0 if one is empty."""
    asked = keys.select("key").distinct().select("key", F.explode(F.array_distinct(probes(F.col("key"), size.hashes, size.bits))).alias("cell"))
    return asked.join(cells, "cell", "left").groupBy("key").agg(F.min(F.coalesce("n", F.lit(0))).cast("long").alias("n"))


def _apart(df: DataFrame) -> DataFrame:
    """``df`` with a key that Spark knows no partitioning of. Spark 4.1 takes a union of parts that are partitioned alike to be so
    itself, also where adaptive execution has joined partitions of one part, and then groups without a shuffle that it needs."""
    return df.withColumn("key", F.element_at(F.array("key"), 1))


def _filled(listed: Column, n: int, kind: str) -> Column:
    """An array of ``n`` values, 0 but for the (place, mask) that are listed in the order of place. A filter is gathered from the
    places that are set; the others are filled in here, so that they are no rows."""
    zero = F.lit(0).cast(kind)

    def with_gap(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(listed, i - 1)["place"], F.lit(-1))
        return F.concat(F.array_repeat(zero, (x["place"] - before - 1).cast("int")), F.array(x["mask"].cast(kind)))

    after = n - 1 - F.coalesce(F.try_element_at(listed, F.lit(-1))["place"], F.lit(-1))
    return F.flatten(F.concat(F.transform(listed, with_gap), F.array(F.array_repeat(zero, after.cast("int")))))


def _gathered(rows: DataFrame, n: str, agg: Column) -> DataFrame:
    """(key, n, dense, listed) from rows (key, n, dense, place, mask): an entry a place, in their order."""
    entries = rows.groupBy("key", n, "dense", "place").agg(agg.alias("mask"))
    return entries.groupBy("key", n, "dense").agg(F.sort_array(F.collect_list(F.struct("place", "mask"))).alias("listed"))


def _placed() -> Column:
    """The entries that have a place: a null is in no filter."""
    return F.filter("listed", lambda e: e["place"].isNotNull())


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _set_values(rows: DataFrame, size: Size) -> DataFrame:
    """(key, value) of hybrid sets from (key, n, dense, x, old): a member x, or the words of a filter in its place."""
    at = rows.select("key", "n", "dense", F.col("old").isNotNull().alias("whole"), "x", "old", probes(F.col("x"), size.hashes, size.bits).alias("at"))
    dense, whole, b = F.col("dense"), F.col("whole"), F.col("b")
    at = at.select("key", "n", "dense", "whole", F.posexplode(F.when(~dense, F.array("x")).when(whole, F.col("old")).otherwise(F.col("at"))).alias("i", "b"))
    place = F.when(~dense, b).when(whole, F.col("i").cast("long")).otherwise(F.shiftright(b, 6))
    mask = F.when(~dense, F.lit(0).cast("long")).when(whole, b).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(63).cast("int")))
    listed = _gathered(at.select("key", "n", "dense", place.alias("place"), mask.alias("mask")), "n", F.bit_or("mask")).select("key", "n", "dense", _placed().alias("listed"))
    members = F.when(~dense, F.transform("listed", lambda e: e["place"]))
    return listed.select("key", F.struct("n", members.alias("members"), F.when(dense, _filled(F.col("listed"), size.bits // 64, "long")).alias("words")).alias("value"))


def hybrid_sets(log: DataFrame, features: int) -> DataFrame:
    """(key, value struct of n, members, words): members while fewer than features / 10, then the words of a 1 % filter."""
    items = log.select("key", F.explode("value").alias("x")).distinct()
    marked = items.join(items.groupBy("key").agg(F.count("*").alias("n")), "key").withColumn("dense", F.col("n") >= features / 10)
    return _set_values(marked.withColumn("old", _none("array<bigint>")), Size.of(features, 0.01))


def merge_hybrid_sets(a: DataFrame, b: DataFrame, features: int) -> DataFrame:
    """Two states of hybrid sets as one. A key that is a filter in either stays one; its n is then the sum, an upper bound."""
    # one row a key in each state, so what is gathered here is bounded
    both = _apart(a).unionByName(_apart(b)).groupBy("key").agg(F.sum("value.n").alias("n"), F.array_distinct(F.flatten(F.collect_list("value.members"))).alias("members"), F.collect_list("value.words").alias("words"))
    n = F.when(F.size("words") > 0, F.col("n")).otherwise(F.size("members")).cast("long")
    marked = both.select("key", n.alias("n"), ((F.size("words") > 0) | (F.size("members") >= features / 10)).alias("dense"), "members", "words")
    parts = F.concat(F.transform("members", lambda x: F.struct(x.alias("x"), _none("array<bigint>").alias("old"))), F.transform("words", lambda w: F.struct(_none("long").alias("x"), w.alias("old"))))
    # explode_outer: a set that holds null alone keeps its row
    return _set_values(marked.select("key", "n", "dense", F.explode_outer(parts).alias("p")).select("key", "n", "dense", "p.x", "p.old"), Size.of(features, 0.01))


def set_contains(value: Column, x: Column, features: int, at: Column | None = None) -> Column:
    """Whether a hybrid set may hold ``x``; exact while it has members. ``at``: a column of the array that ``set_places`` gives, for
    reads in rows of their own; Spark compiles them with the row, so that the value isn't copied for each."""

    def is_set(bit: Column) -> Column:
        return F.call_function("getbit", F.get(value["words"], F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(63).cast("int")) == 1

    if at is None:
        inside = F.forall(set_places(x, features), is_set)
    else:
        inside = reduce(lambda p, q: p & q, [is_set(F.get(at, i)) for i in range(Size.of(features, 0.01).hashes)])
    return F.when(value["members"].isNotNull(), F.array_contains(value["members"], x)).otherwise(inside)


def set_places(x: Column, features: int) -> Column:
    """The places of ``x`` in a hybrid set or in hybrid counts; compiled, where it is a column of its own."""
    size = Size.of(features, 0.01)
    return probes(x, size.hashes, size.bits)


def _count_values(rows: DataFrame, size: Size, agg: Column) -> DataFrame:
    """(key, value) of hybrid counts from (key, total, dense, k, n, old): a count, or the cells of a filter in its place."""
    at = rows.select("key", "total", "dense", F.col("old").isNotNull().alias("whole"), "k", "n", "old", probes(F.col("k"), size.hashes, size.bits).alias("at"))
    dense, whole = F.col("dense"), F.col("whole")
    at = at.select("key", "total", "dense", "whole", "n", F.posexplode(F.when(~dense, F.array("k")).when(whole, F.col("old")).otherwise(F.array_distinct("at"))).alias("i", "b"))
    at = at.select("key", "total", "dense", F.when(dense & whole, F.col("i").cast("long")).otherwise(F.col("b")).alias("place"), F.when(dense & whole, F.col("b")).otherwise(F.col("n")).alias("mask"))
    listed = _gathered(at.filter("not dense or mask <> 0"), "total", agg)
    counts = F.when(~dense, F.transform("listed", lambda e: F.struct(e["place"].alias("k"), e["mask"].alias("n"))))
    cells = F.when(dense, F.transform(_placed(), lambda e: F.struct(e["place"], F.least(e["mask"], F.lit(255)).alias("mask"))))
    found = listed.select("key", "total", counts.alias("counts"), cells.alias("cells"))
    return found.select("key", F.struct("total", "counts", F.when(F.col("cells").isNotNull(), _filled(F.col("cells"), size.bits, "smallint")).alias("cells")).alias("value"))


def hybrid_counts(log: DataFrame, most: int) -> DataFrame:
    """(key, value struct of total, counts, cells): exact counts while fewer than most / 10 keys, then a counting filter of 1 %."""
    items = log.select("key", F.explode("value").alias("e")).groupBy("key", F.col("e.k").alias("k")).agg(F.sum("e.n").alias("n"))
    marked = items.join(items.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")), "key").withColumn("dense", F.col("kinds") >= most / 10)
    return _count_values(marked.withColumn("old", _none("array<bigint>")), Size.of(most, 0.01), F.max("mask"))


def merge_hybrid_counts(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """Two states of hybrid counts as one. A key that is a filter in either stays one."""
    # one row a key in each state, so what is gathered here is bounded
    both = _apart(a).unionByName(_apart(b)).groupBy("key").agg(F.sum("value.total").alias("total"), F.flatten(F.collect_list("value.counts")).alias("counts"), F.collect_list("value.cells").alias("cells"))
    dense = (F.size("cells") > 0) | (F.size(F.array_distinct(F.transform("counts", lambda c: c["k"]))) >= most / 10)
    lists = F.transform("counts", lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n"), _none("array<bigint>").alias("old")))
    filters = F.transform("cells", lambda w: F.struct(_none("long").alias("k"), _none("long").alias("n"), w.cast("array<bigint>").alias("old")))
    rows = both.select("key", "total", dense.alias("dense"), F.explode(F.concat(lists, filters)).alias("p")).select("key", "total", "dense", "p.k", "p.n", "p.old")
    return _count_values(rows, Size.of(most, 0.01), F.sum("mask"))


def counted(value: Column, k: Column, most: int) -> Column:
    """The count of ``k`` in hybrid counts: exact while they are a list, else never too low below 255."""
    listed = F.coalesce(F.get(F.transform(F.filter(value["counts"], lambda c: c["k"] == k), lambda c: c["n"]), 0), F.lit(0)).cast("long")
    return F.when(value["counts"].isNotNull(), listed).otherwise(F.array_min(F.transform(set_places(k, most), lambda p: F.get(value["cells"], p.cast("int")))).cast("long"))


def filter_count(value: Column, at: Column, most: int) -> Column:
    """The count in hybrid counts that are a filter, in a row for each key read; ``at`` as in ``set_contains``."""
    return F.array_min(F.array(*[F.get(value["cells"], F.get(at, i).cast("int")) for i in range(Size.of(most, 0.01).hashes)])).cast("long")


@dataclass(frozen=True)
class CountsFilter:
    """Approximate counts of keys: a counting filter of class numbers, a filter of keys counted once, and the mean count of each class."""

    cells: DataFrame
    singles: DataFrame
    averages: DataFrame
    size: Size
    singles_size: Size


def class_of(n: Column, levels: int = 10) -> Column:
    """The class of a count of 2 or more, from 1; ``levels`` of them double it."""
    return (F.floor(F.log2(n) * levels) - levels + 1).cast("long")


def counts_filter(counted: DataFrame, size: Size, singles_size: Size, levels: int = 10) -> CountsFilter:
    """From (key, n). A cell holds the largest class of its keys, of which there are 64 * levels at most."""
    many = counted.filter("n > 1").withColumn("level", class_of(F.col("n"), levels))
    cells = cells_of(many.select("key", F.col("level").alias("n")), size, 64 * levels)
    averages = many.groupBy("level").agg(F.avg("n").alias("average"))
    return CountsFilter(cells, bits_of(counted.filter("n = 1"), singles_size), averages, size, singles_size)


def approximate_count(found: CountsFilter, keys: DataFrame) -> DataFrame:
    """(key, level, approximate) of the distinct requested keys, from the filters alone: the mean of a key's class; 1 if only the
    filter of single keys has it; 0 if neither has."""
    asked = max_count(found.cells, keys, found.size).withColumnRenamed("n", "level")
    asked = asked.join(might_contain(found.singles, keys, found.singles_size), "key")
    asked = asked.join(F.broadcast(found.averages), "level", "left")  # one row a class
    return asked.select("key", "level", F.coalesce("average", F.when(F.col("present"), 1.0).otherwise(0.0)).alias("approximate"))
