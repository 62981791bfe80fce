"""Folds of a growing log: bounded state per key, one version of the state for each micro-batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import BUCKETS, bucket


def partial_sums(rows: DataFrame) -> DataFrame:
    """(key, reset, value): whether a tombstone is among a key's rows, and the sum of what follows the last."""
    last = rows.filter("value is null").groupBy("key").agg(F.max("seq").alias("at"))
    kept = rows.join(last, "key", "left").withColumn("live", F.col("value").isNotNull() & (F.col("at").isNull() | (F.col("seq") > F.col("at"))))
    return kept.groupBy("key").agg(F.max(F.col("at").isNotNull()).alias("reset"), F.sum(F.when(F.col("live"), F.col("value"))).alias("value"))


def merge_sums(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state (key, value) after a later batch of partial sums. A key that ends with a tombstone goes."""
    a, b = state.withColumnRenamed("value", "old"), batch.withColumnRenamed("value", "new")
    both = a.join(b, "key", "full_outer")
    value = F.when(F.coalesce("reset", F.lit(False)), F.col("new")).otherwise(F.coalesce(F.col("old") + F.col("new"), F.col("old"), F.col("new")))
    return both.select("key", value.alias("value")).filter("value is not null")


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path, fs = _files(spark, f"{folder}/version-*.json")
    return sorted(int(f.getPath().getName()[8:-5]) for f in fs.globStatus(path) or [])


def _places(spark: SparkSession, folder: str, version: int) -> dict[str, int]:
    """In which batch each bucket was last written, by a version."""
    return json.loads(spark.read.text(f"{folder}/version-{version:08d}.json", wholetext=True).first()[0])


def read_sums(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(key, value): the last version of a maintained state, or one of the last two."""
    there = _versions(spark, folder)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.LongType())])
    places = _places(spark, folder, there[-1] if version is None else version) if there else {}
    paths = [f"{folder}/data-{n:08d}/bucket={b}" for b, n in places.items()]
    paths = [p for p in paths if _files(spark, p)[1].exists(_files(spark, p)[0])]  # a bucket may have lost all its keys
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _apply(rows: DataFrame, n: int, folder: str) -> None:
    """Writes version ``n`` from the one before it: the buckets that the batch touches anew, and a list of where each bucket lies."""
    spark = rows.sparkSession
    earlier = [v for v in _versions(spark, folder) if v < n]
    places = _places(spark, folder, earlier[-1]) if earlier else {}
    batch = partial_sums(rows).withColumn("bucket", bucket(F.col("key")))
    batch.persist()
    touched = sorted(r[0] for r in batch.select("bucket").distinct().collect() if r[0] is not None)  # 64 at most
    before = read_sums(spark, folder, earlier[-1]) if earlier else spark.createDataFrame([], "key long, value long")
    before = before.filter(bucket(F.col("key")).isin(touched)) if len(touched) < BUCKETS else before
    merged = merge_sums(before, batch.drop("bucket")).withColumn("bucket", bucket(F.col("key")))
    merged.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data-{n:08d}")
    batch.unpersist()
    places |= {str(b): n for b in touched}
    path, fs = _files(spark, f"{folder}/version-{n:08d}.json.tmp")
    out = fs.create(path, True)
    out.write(bytearray(json.dumps(places).encode()))
    out.close()
    final, _ = _files(spark, f"{folder}/version-{n:08d}.json")
    fs.delete(final, False)
    fs.rename(path, final)
    # what neither this version nor the one before it reads
    for v in earlier[:-1]:
        fs.delete(_files(spark, f"{folder}/version-{v:08d}.json")[0], False)
    used = {*places.values(), *(_places(spark, folder, earlier[-1]).values() if earlier else ())}
    for f in fs.globStatus(_files(spark, f"{folder}/data-*")[0]) or []:
        if int(f.getPath().getName()[5:]) not in used | {n}:
            fs.delete(f.getPath(), True)


def maintain_sums(spark: SparkSession, log: DataFrame, folder: str, on_update: Callable[[DataFrame, int], None] | None = None, every: str | None = None):
    """Folds a stream of (key, seq, value) into sums by key under ``folder``, which read_sums reads. Micro-batches must
    come in the order of seq, as appends do.

    Runs to the stream's present end and returns the state; with ``every``, such as "1 second", it goes on in
    that rhythm, and the running query is returned. A batch that is repeated after a failure rewrites its own version from the
    one before it, so each is applied once. Only the buckets of keys that a batch touches are rewritten, and the last two versions are kept. ``on_update`` gets the
    raw rows of a batch, after they can be read.
    """

    def apply(rows: DataFrame, n: int) -> None:
        _apply(rows, n, folder)
        if on_update:
            on_update(rows, n)

    writer = log.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/progress")
    if every:
        return writer.trigger(processingTime=every).start()
    writer.trigger(availableNow=True).start().awaitTermination()
    return read_sums(spark, folder)


def complete_fold(log: DataFrame, agg: F.Column) -> DataFrame:
    """A streaming state in complete mode by one aggregate, such as max_by(value, seq)."""
    return log.groupBy("key").agg(agg.alias("value"))
