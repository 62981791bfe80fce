"""Mixing sources to target weights by Poisson replication, in SQL functions alone.

Each source has a mean repetition rate: its target share of the rows over its present share. A row's number of
copies is the inverse of the Poisson distribution of that mean at a uniform number hashed from the seed and the
row's id, so it doesn't depend on partitions or order, and a rerun draws the same.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, unused, uniform

#: A larger mean is drawn as a sum of Poisson numbers of this mean at most, so that exp(-mean) stays a normal double.
PIECE_MEAN = 256
#: The rates of so many sources are broadcast (about 0.4 KB each); those of more are joined with salted keys.
MOST_BROADCAST = 20_000
SALTS = 32


#: Bytes of text that a task of the global shuffle gets.
TASK_BYTES = 128 << 20


def sizes(docs: DataFrame, source_col: str, text_col: str) -> DataFrame:
    """(source, rows, bytes), kept: all that is known of the table comes from this one scan."""
    return cut(docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("rows"), F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64).alias("bytes")))


def rates(found: DataFrame, weights: dict[str, float] | None, total: float | None) -> DataFrame:
    """(source, rate, bytes): weight / sum of weights * total / rows of that source; equal weights if none are given. bytes are those expected."""
    if weights is None:
        found = found.withColumn("weight", F.lit(1.0))
    elif weights:
        named = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        found = found.withColumn("weight", F.coalesce(named[F.col("source")], F.lit(0.0)))
    else:
        found = found.withColumn("weight", F.lit(0.0))
    weighed, rows = found.agg(F.sum("weight"), F.sum("rows")).first()
    target = float(total if total is not None else rows or 0)
    rate = F.col("weight") / F.lit(weighed) * F.lit(target) / F.col("rows") if weighed else F.lit(0.0)
    return found.select("source", rate.alias("rate"), (rate * F.col("bytes")).alias("bytes"))


def with_distribution(rate: DataFrame) -> DataFrame:
    """Adds the cumulative Poisson distribution of each source's mean, or of a part of it if it is large."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE_MEAN)).cast("int")
    out = rate.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 30).cast("int"))
    cdf = F.expr("""aggregate(steps, struct(exp(-mean) as p, exp(-mean) as c, array(exp(-mean)) as cdf),
        (a, k) -> struct(a.p * mean / k as p, a.c + a.p * mean / k as c, array_append(a.cdf, a.c + a.p * mean / k) as cdf),
        a -> a.cdf)""")
    return out.withColumn("steps", steps).withColumn("cdf", cdf).drop("steps")


def poisson_mix(docs: DataFrame, *, weights: dict[str, float] | None = None, total: float | None = None, seed: str = "0", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns of ``docs``, with copy (from 1), n_copies, rate and shuffle_key; a row for each copy.

    The rows are dealt to the shuffle partitions, more of them if a task would get over TASK_BYTES, by a hash of shuffle_key, itself an md5 of seed, id and copy, and
    sorted by it within each, so that neighbours are unrelated. ``weights`` maps source to weight: sources that it
    doesn't name get none; None weighs all sources alike, a null source being one of them. ``total`` is the expected
    number of rows, as many as come in by default. A row with a null id draws by an md5 of its text; repeated rows of one id
    draw alike. Columns of the names added here are replaced. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    added = ("copy", "n_copies", "rate", "shuffle_key")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    source, parts, cdf, salt, salt2 = (unused(docs, n) for n in ("source", "parts", "cdf", "salt", "salt2"))
    found = rates(sizes(docs, source_col, text_col), weights, total)
    n, expected = found.agg(F.count("*"), F.sum("bytes")).first()
    table = with_distribution(found).select(F.col("source").alias(source), "rate", F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    if n <= MOST_BROADCAST:
        joined = docs.join(F.broadcast(table), docs[source_col].eqNullSafe(table[source]))
    else:
        table = table.withColumn(salt2, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn(salt, F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS)).cast("int"))
        joined = docs.join(table, docs[source_col].eqNullSafe(table[source]) & (F.col(salt) == F.col(salt2))).drop(salt, salt2)
    who = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    draw = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda n, i: n + F.size(F.filter(cdf, lambda c: c <= uniform(F.lit(seed), who, i))))
    out = joined.withColumn("n_copies", draw).filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit("order"), F.lit(seed), who, F.col("copy").cast("string")).cast("binary"))).drop(source, parts, cdf)
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((expected or 0) / TASK_BYTES))
    return out.repartition(width, "shuffle_key").sortWithinPartitions("shuffle_key")
