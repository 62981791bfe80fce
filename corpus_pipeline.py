"""A training corpus from ``documents``: language ID, near-dedup, mixing to target weights, BPE.

Each stage takes all that its predecessor kept. It is one of the operators of tallyforge.llm; run() writes each result
as a table in the cluster's shared folder and reads it again, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, language_id, mixing, near_dedup
from tallyforge.llm.common import shared_folder, ship
from tallyforge.llm.queries import word_bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: without a letter (null and empty texts too), or unlike every language learned from ``docs``.

    Every row with a lang teaches, whatever its id: nothing is held out here, as no accuracy is measured. Rows with a null lang are judged,
    but teach nothing. Repeated rows are judged alike. An empty table gives an empty one.
    """
    ship(spark)
    return language_id.annotate(docs, language_id.fit(docs)).filter("not rejected").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by a similarity of 0.8 of their five-word shingles one row stays: that of the smallest id,
    or any where all ids are null.

    Each row goes by its own text, so rows that repeat an id with unrelated texts all stay. Texts without a shingle are
    in no group; of equal rows of id and text one stays.
    """
    ship(spark)
    text = F.concat(F.when(F.col("text").isNull(), "-").otherwise("|"), F.coalesce("text", F.lit("")))
    docs = docs.select(*COLUMNS, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)).alias("mark"))
    found = near_dedup.near_duplicates(docs, shingle_words=5, percent=80, bands=20, mark=F.col("mark"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    kept = found.groupBy(F.coalesce(F.col("group").cast("string"), "mark")).agg(first.alias("first")).select("first.mark")
    return docs.join(kept, "mark").dropDuplicates(["mark"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that all sources have the same expected number of rows; shuffles globally.

    A null source is one of them; rows of a null id draw by their text. An empty table gives an empty one.
    """
    return mixing.poisson_mix(docs).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text: doc_id, source, lang, n_tokens, ids. A null or empty text has none; every row gives a row."""
    ship(spark)
    return bpe.encode_with(docs, word_bpe(), ["doc_id", "source", "lang"])


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Language models, MinHash and BPE aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # what no stage reads any more
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return docs
