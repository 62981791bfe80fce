"""Reads, indexes, rankings, sketches."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import keys, text
from tallyforge.operators import combinators as C
from tallyforge.operators import index, ranking, reads, sketches
from tallyforge.operators.fold import fold


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(100).select(F.col("id").alias("key"), F.col("id").alias("value"))


def asked(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key long")


def test_reads(spark, numbers):
    assert reads.point(numbers, 5).first()["value"] == 5
    assert sorted(r["key"] for r in reads.multi_get(numbers, asked(spark, [10, 3, 3, 500])).collect()) == [3, 3, 10]
    assert {r["key"]: r["value"] for r in reads.counts_of(numbers, asked(spark, [7, 777])).collect()} == {7: 7, 777: 0}
    assert reads.key_range(numbers, 0, 50).count() == 50 == reads.where(numbers, F.col("value") % 2 == 0).count()
    assert reads.key_set(numbers, [1, 2, 999]).count() == 2 == reads.key_set(numbers, asked(spark, [1, 1, 2])).count()
    assert {r["key"]: r["present"] for r in reads.might_contain(numbers, asked(spark, [1, 100])).collect()} == {1: True, 100: False}
    assert reads.exact_size(numbers).first()["n"] == 100 and 90 < reads.approximate_size(numbers).first()["n"] < 110


def test_checksum_ignores_what_is_undone(spark):
    before = spark.createDataFrame([(i, 0, i * 31) for i in range(10)], "key long, seq long, value long")
    more = spark.createDataFrame([(i, s, v) for i in range(10) for s, v in ((1, 2), (2, -2))], before.schema)
    one = reads.checksum(fold(before, C.LONG)).first()[0]
    assert reads.checksum(fold(before.union(more), C.LONG)).first()[0] == one != 0
    assert reads.checksum(fold(before.filter("false"), C.LONG)).first()[0] == 0


def test_range_reaches_the_scan(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("key"), F.col("id").alias("value")).write.parquet(f"{tmp_path}/s")
    plan = reads.values_only(reads.key_range(spark.read.parquet(f"{tmp_path}/s"), 5, 9))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,5)" in plan and "LessThan(key,9)" in plan


def test_text_index(spark):
    docs = spark.createDataFrame([(1, "This is a test"), (2, "Negative example")], "key long, value string")
    assert {tuple(r) for r in index.multi_index(docs, text.tokens).filter("key = 2").collect()} == {("negative", 2), ("example", 2)}
    assert [r["key"] for r in index.postings(docs, text.tokens, "this").collect()] == [1]
    assert [r["key"] for r in index.by_example(docs, text.tokens, "Another test IS").collect()] == [1]
    assert [r["key"] for r in index.by_index_key(docs, text.tokens, lambda t: t.startswith("ex")).collect()] == [2]
    assert index.postings(docs, text.tokens, "yolo").count() == 0


def test_inverted_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "key long, value string")
    index.write_inverted(index.inverted(docs, text.tokens(F.col("value"))), f"{tmp_path}/i")
    found = {r["token"]: [tuple(p) for p in r["postings"]] for r in index.gathered(spark.read.parquet(f"{tmp_path}/i")).collect()}
    assert found == {"a": [(1, 0), (1, 2)], "b": [(1, 1), (2, 0)]}


def test_unique_index(spark):
    state = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "key long, value long")
    twice = lambda v: F.when(v == 10, 10).otherwise(2 * v)
    found = index.unique_index(state, twice)
    assert tuple(found.filter("ikey = 6").first()) == (6, 3, 3)
    with pytest.raises(Exception, match="not unique"):
        index.unique_index(state.union(spark.createDataFrame([(4, 5), (5, 10)], state.schema)), twice).collect()


def test_bigrams(spark):
    row = spark.createDataFrame([("One two two",), ("one",), ("",)], "t string").select(text.bigrams(F.col("t")))
    assert [r[0] for r in row.collect()] == [["one two", "two two"], [], []]


def test_ranking(spark):
    row = spark.createDataFrame([([(1, 5), (2, 9), (0, 5)],)], "c array<struct<k:long,n:long>>")
    got = row.select(ranking.sorted_keys(F.col("c")), ranking.total(F.col("c")), ranking.count_of(F.col("c"), F.lit(2)), ranking.count_of(F.col("c"), F.lit(3)), text.preview(F.col("c"), 2)).first()
    assert list(got) == [[2, 0, 1], 19, 9, 0, "1:5 2:9 ..."]


def test_bloom(spark):
    rng = random.Random(5)
    members = [(rng.getrandbits(64) - 2**63,) for _ in range(3000)] + [(0,), (2**32,), (-1,)]
    size = sketches.Size.of(len(members), 0.05)
    own = spark.createDataFrame(members, "key long")
    bits = sketches.bits_of(own, size)
    assert sketches.might_contain(bits, own, size).filter("not present").count() == 0
    others = spark.createDataFrame([(rng.getrandbits(64) - 2**63,) for _ in range(3000)], "key long")
    assert sketches.might_contain(bits, others, size).filter("present").count() / 3000 < 0.1
    half = [sketches.bits_of(own.filter(f"pmod(key, 2) = {i}"), size) for i in (0, 1)]
    assert sketches.merge_bits(*half).exceptAll(bits).count() == 0 and sketches.merge_bits(*half).count() == bits.count()
    words = sketches.merge_words(*map(sketches.words_of, half))
    assert words.agg(F.sum(F.bit_count("mask"))).first()[0] == bits.count()
    assert 0 < sketches.expected_fpp(bits, size).first()["fpp"] < 0.1
    assert sketches.bits_of(own.filter("false"), size).count() == 0
    for bad in ((0, 0.1), (5, 0.0), (5, 1.0)):
        with pytest.raises(ValueError):
            sketches.Size.of(*bad)
    assert sketches.Size.of(2**33, 0.1).hashes == 3
    stored = sketches.with_check_sum(words, size, "x")
    assert sketches.words_contain(stored, own).filter("not present").count() == 0
    assert sketches.words_contain(stored, others).exceptAll(sketches.might_contain(bits, others, size)).count() == 0
    assert sketches.words_contain(stored.filter("false"), others).filter("present").count() == 0
    assert sketches.words_fpp(stored).first()["fpp"] == pytest.approx(sketches.expected_fpp(bits, size).first()["fpp"])


def test_counting_filter(spark):
    rows = spark.createDataFrame([(i, i + 1) for i in range(300)], "key long, n long")
    size = sketches.Size.of(300, 0.01)
    cells = sketches.cells_of(rows, size)
    for r in sketches.max_count(cells, rows, size).collect():
        assert r["n"] >= min(r["key"] + 1, 255) and r["n"] <= 255
    assert sketches.max_count(cells, asked(spark, [10**9]), size).first()["n"] in (0, *range(1, 256))
    double = sketches.merge_cells(cells, cells)
    assert double.agg(F.max("n")).first()[0] == 255
    plain = {r["key"]: r["n"] for r in sketches.max_count(sketches.cells_of(rows, size, conservative=False), rows, size).collect()}
    assert all(r["n"] <= plain[r["key"]] for r in sketches.max_count(cells, rows, size).collect())
    assert 0 < sketches.cells_fpp(sketches.cells_of(rows.withColumn("key", F.xxhash64("key")), size), size).first()["fpp"] < 0.02


def test_counts_filter(spark):
    hashed = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    rows = spark.createDataFrame([(hashed(i), 1 if i < 500 else 2 ** (i % 12)) for i in range(1000)], "key long, n long")
    others = spark.createDataFrame([(hashed(-1 - i), 0) for i in range(1000)], rows.schema)
    found = sketches.counts_filter(rows, sketches.Size.of(1000, 0.001), sketches.Size.of(500, 0.001))
    got = {r["key"]: r["approximate"] for r in sketches.approximate_count(found, rows.unionByName(others)).collect()}
    right = sum(got[r["key"]] == r["n"] for r in rows.collect())
    assert right > 980 and sum(got[r["key"]] == 0 for r in others.collect()) > 980


def kept(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_hybrid_sets(spark):
    log = spark.createDataFrame([(1, 0, [5, 6]), (1, 1, [6]), (2, 0, list(range(200)))], "key long, seq long, value array<long>")
    state = kept(fold(log, C.compact_index(1000)))
    got = {r["key"]: r["value"] for r in state.collect()}
    assert got[1]["members"] == [5, 6] and got[2]["members"] is None and got[2]["n"] == 200
    probe = state.crossJoin(spark.range(200).withColumnRenamed("id", "x")).select("key", "x", sketches.set_contains(F.col("value"), F.col("x"), 1000).alias("in"))
    assert probe.filter("key = 2 and not in").count() == 0
    assert sorted(r["x"] for r in probe.filter("key = 1 and in").collect()) == [5, 6]
    more = fold(spark.createDataFrame([(1, 0, [7]), (2, 0, [10**6]), (3, 0, list(range(60))), (4, 0, [1])], log.schema), C.compact_index(1000))
    third = fold(spark.createDataFrame([(3, 0, list(range(50, 130)))], log.schema), C.compact_index(1000))
    merged = sketches.merge_hybrid_sets(sketches.merge_hybrid_sets(state, more, 1000), third, 1000)
    merged = kept(merged)
    got = {r["key"]: r["value"] for r in merged.collect()}
    assert got[1]["members"] == [5, 6, 7] and got[4]["members"] == [1] and got[2]["n"] == 201 and got[3]["n"] == 130 and got[3]["members"] is None
    tried = [0, 8, 59, 129, 199, 10**6, *range(10**7, 10**7 + 30)]
    found = merged.select("key", F.filter(F.lit(tried).cast("array<bigint>"), lambda x: sketches.set_contains(F.col("value"), x, 1000)).alias("in"))
    inside = {r["key"]: r["in"] for r in found.collect()}
    assert {0, 199, 10**6} <= set(inside[2]) and {0, 59, 129} <= set(inside[3]) and not inside[1] and len(inside[3]) < 10


def test_hybrid_counts(spark):
    log = spark.createDataFrame([(1, 0, [(5, 2), (6, 1)]), (1, 1, [(5, 1)])], "key long, seq long, value array<struct<k:long,n:long>>")
    value = fold(log, C.compact_counts(1000)).first()["value"]
    assert value["total"] == 4 and [tuple(x) for x in value["counts"]] == [(5, 3), (6, 1)]
    big = spark.createDataFrame([(2, 0, [(i, i + 1) for i in range(150)])], log.schema)
    state = fold(log.unionByName(big), C.compact_counts(1000))
    few = fold(spark.createDataFrame([(1, 0, [(6, 4)]), (2, 0, [(7, 100), (9999, 3)])], log.schema), C.compact_counts(1000))
    for merged in (sketches.merge_hybrid_counts(state, few, 1000), sketches.merge_hybrid_counts(few, state, 1000)):
        merged = kept(merged)
        found = merged.select("key", F.transform(F.lit([5, 6, 7, 77, 100, 9999]).cast("array<bigint>"), lambda k: sketches.counted(F.col("value"), k, 1000)).alias("n"))
        read = {r["key"]: r["n"] for r in found.collect()}
        assert read[1] == [3, 5, 0, 0, 0, 0] and all(a >= b for a, b in zip(read[2], (6, 7, 108, 78, 101, 3)))
        assert {r["key"]: r["value"]["total"] for r in merged.collect()} == {1: 8, 2: 150 * 151 // 2 + 103}
    alone = sketches.merge_hybrid_counts(fold(big, C.compact_counts(1000)), few.filter("key = 1"), 1000).filter("key = 2")
    assert alone.select(sketches.counted(F.col("value"), F.lit(9).cast("long"), 1000)).first()[0] >= 10


def test_codec(spark):
    values = [0, 1, -1, 255, 2**63 - 1, -(2**63)]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", keys.to_bytes(F.col("v")).alias("b")).withColumn("again", keys.from_bytes(F.col("b"))).collect()
    assert [bytes(r["b"]) for r in got] == [v.to_bytes(8, "big", signed=True) for v in values] and [r["again"] for r in got] == values
    assert spark.range(1).select(keys.from_bytes(F.lit(None).cast("binary"))).first()[0] is None


def test_buckets(spark):
    got = spark.createDataFrame([(k,) for k in (0, 31, 32, 63, -1, -(2**63))], "key long").select(keys.bucket(F.col("key"))).collect()
    assert [r[0] for r in got] == [32, 63, 0, 31, 31, 32]
    assert spark.range(1).select(keys.key64(F.lit("anna"))).first()[0] == int(hashlib.md5(b"anna").hexdigest()[:15], 16)
