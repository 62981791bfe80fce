"""What showed only on larger tables, or on nulls."""

from pyspark.sql import functions as F

from tallyforge.operators import combinators as C
from tallyforge.operators import sketches
from tallyforge.operators.fold import fold
from tallyforge.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_empty_cells_of_count_filters_are_no_rows(spark):
    log = spark.createDataFrame([(1, 0, [(i, i + 1) for i in range(150)] + [(None, 9)]), (2, 0, [(5, 1)])], "key long, seq long, value array<struct<k:long,n:long>>")
    state = fold(log, C.compact_counts(1000))
    got = {r["key"]: r["value"] for r in state.collect()}
    assert len(got[1]["cells"]) == sketches.Size.of(1000, 0.01).bits and got[2]["cells"] is None
    read = state.filter("key = 1").select(F.transform(F.lit(list(range(150))).cast("array<bigint>"), lambda k: sketches.counted(F.col("value"), k, 1000))).first()[0]
    assert all(a >= i + 1 for i, a in enumerate(read)) and sum(a == i + 1 for i, a in enumerate(read)) > 140
    assert "sequence(" not in plan(state) and "sequence(" not in plan(sketches.merge_hybrid_counts(state, state, 1000))


def test_ordered_scan_keeps_each_row_and_its_place(spark, tmp_path):
    orders = spark.range(0, 400_000, 1, 4).select(((F.col("id") * 7919) % 400_009).alias("o_orderkey"), (F.col("id") % 1000 + 0.5).alias("o_totalprice"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    rows = catalogue.QUERIES["ordered_scan"](spark, str(tmp_path)).toPandas().sort_values("key")
    assert len(rows) == 400_000 and (rows["place"].to_numpy() == range(400_000)).all()


def _missed(spark, state, members):
    asked = spark.createDataFrame([(m,) for m in members], "x long").withColumn("at", sketches.set_places(F.col("x"), 1000))
    both = asked.crossJoin(state.select("value"))
    inside = [sketches.set_contains(F.col("value"), F.col("x"), 1000, at) for at in (None, F.col("at"))]
    return [both.filter(~i).count() for i in inside]


def test_merged_sets_with_a_null_keep_their_members(spark):
    parts = [fold(spark.createDataFrame([(1, 0, [None, *m])], "key long, seq long, value array<long>"), C.compact_index(1000)) for m in (range(70), range(60, 260))]
    state = sketches.merge_hybrid_sets(*parts, 1000)
    assert state.count() == 1 and _missed(spark, state, range(260)) == [0, 0]
    assert "sequence(" not in plan(state)


def test_sets_with_a_null_keep_their_members(spark):
    log = spark.createDataFrame([(1, 0, [None, *range(200)])], "key long, seq long, value array<long>")
    state = fold(log, C.compact_index(1000))
    assert len(state.first()["value"]["words"]) == sketches.Size.of(1000, 0.01).bits // 64 and _missed(spark, state, range(200)) == [0, 0]
    assert "sequence(" not in plan(state)
