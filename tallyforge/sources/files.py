"""Files of bytes, lines and single objects, and the two streams of keys that benchmarks count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import remix
from ..functions.text import bigrams, tokens


def byte_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the files under a path of any file system that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def store_object(row: DataFrame, path: str) -> None:
    """One object as one JSON file; a table of more rows, or of none, is refused."""
    if row.limit(2).count() != 1:
        raise ValueError("an object is one row")
    row.coalesce(1).write.mode("overwrite").json(path)


def read_object(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: A scan estimated at fewer bytes is dealt out anew before work on its rows.
SMALL_SCAN = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small table to all cores: a small Parquet file is one row group, which one task must read.

    Tables over 64 MB are left alone, as they have row groups enough; so what this shuffles is bounded.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    small = int(str(size)) < SMALL_SCAN
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if small else df


def bigram_keys(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(key) a 64-bit hash for each pair of adjacent tokens, hashed in place: no string is made of a pair."""
    t = tokens(F.col(text_col))
    n = F.greatest(F.size(t) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: remix(F.struct(a, b)))
    return spread(texts.select(text_col)).select(F.explode(pairs).alias("key"))


def bigram_stream(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(key) a row for each pair of adjacent tokens."""
    return spread(texts.select(text_col)).select(F.explode(bigrams(F.col(text_col))).alias("key"))


def uniform_stream(spark: SparkSession, n: int, below: int = 1_000_000, seed: int = 0) -> DataFrame:
    """(key, seq, value 1): random keys, the same for a seed however they are partitioned."""
    return spark.range(n).select(F.pmod(remix(F.struct("id", F.lit(seed))), F.lit(below)).alias("key"), F.col("id").alias("seq"), F.lit(1).cast("long").alias("value"))
