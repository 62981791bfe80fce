"""Stores: an append-only log in 64 buckets with compaction by generations, a filter of its keys, stores in memory, objects
by their own ids, and a catalogue."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import bucket, key64
from ..operators import combinators, sketches
from ..operators.combinators import Combinator
from ..operators.fold import fold


@dataclass(frozen=True)
class StoreConfig:
    """What a store holds and how: the type of its values, its combinator, and whether it is cached, temporary, kept in memory, or
    has a bloom filter of its keys."""

    name: str
    value: str | T.DataType
    combinator: Combinator = combinators.OVERWRITE
    cached: bool = False
    temporary: bool = False
    bloom: bool = False
    in_memory: bool = False

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a store needs a name")
        if self.value is None or self.combinator is None:
            raise ValueError("a store needs a type of value and a combinator")

    @property
    def schema(self) -> T.StructType:
        kind = self.value if isinstance(self.value, T.DataType) else T._parse_datatype_string(self.value)
        return T.StructType([T.StructField("key", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("value", kind)])


@dataclass
class Store:
    """A folder with ``log`` (appended, by generation and bucket) and ``state-<generation>`` (compacted). One writer at a time.

    Writes are visible after flush(), which writes what was buffered as one append. compact() begins a new generation:
    reads then fold the compacted state with what was appended since, not the whole history. So the seq of a key's
    writes must not fall from one flush to the next.
    """

    spark: SparkSession
    config: StoreConfig
    folder: str
    pending: list[DataFrame] = field(default_factory=list)
    listeners: list = field(default_factory=list)
    held: list[DataFrame] = field(default_factory=list)
    closed: bool = False

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError(f"store {self.config.name} is closed")

    def write(self, rows: DataFrame) -> Store:
        """Buffers (key, seq, value); a null value removes. String keys are hashed."""
        self._open()
        if dict(rows.dtypes)["key"] == "string":
            rows = rows.withColumn("key", key64(F.col("key")))
        self.pending.append(rows.select(*[F.col(f.name).cast(f.dataType) for f in self.config.schema]))
        return self

    def increase(self, rows: DataFrame, delta: int = 1) -> Store:
        """Adds ``delta`` to the count of each row's key; seq must be a column, or all are one write."""
        seq = F.col("seq") if "seq" in rows.columns else F.lit(0)
        return self.write(rows.select("key", seq.alias("seq"), F.lit(delta).alias("value")))

    def remove(self, keys: DataFrame) -> Store:
        """Writes tombstones for (key, seq)."""
        return self.write(keys.select("key", "seq", F.lit(None).cast(self.config.schema["value"].dataType).alias("value")))

    def flush(self) -> Store:
        self._open()
        if self.pending:
            rows = reduce(DataFrame.unionByName, self.pending).withColumn("gen", F.lit(self._generation())).withColumn("bucket", bucket(F.col("key")))
            # few files for each bucket, and more than one task for a large one
            rows.hint("rebalance", F.col("bucket")).write.partitionBy("gen", "bucket").mode("append").parquet(f"{self.folder}/log")
        written, self.pending = self.pending, []
        self._tell(written)
        return self

    def _tell(self, written: list[DataFrame]) -> None:
        """Frees what a write has made old and calls the listeners, with the rows as they were written."""
        self._forget()
        for rows in written:
            for tell in self.listeners:
                tell("updated", rows)
        for tell in self.listeners:
            tell("flushed", None)

    def _path(self, part: str):
        """A path and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _generation(self) -> int:
        """How many compactions have been completed: a state counts once its job has committed."""
        path, fs = self._path("state-*/_SUCCESS")
        return max([int(f.getPath().getParent().getName().removeprefix("state-")) for f in fs.globStatus(path) or []], default=0)

    def _read(self, part: str, more: list[T.StructField], salvage: bool = False) -> DataFrame:
        schema = T.StructType([*self.config.schema.fields, *more])
        path, fs = self._path(part)
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", salvage).option("ignoreMissingFiles", salvage).parquet(f"{self.folder}/{part}")

    def log(self, salvage: bool = False) -> DataFrame:
        """The flushed log since the last compaction with its bucket, a partition column; first of all what was compacted. A damaged
        file is an error, unless ``salvage`` is asked for, which leaves it out."""
        self._open()
        gen, own = self._generation(), T.StructField("bucket", T.IntegerType())
        tail = self._read("log", [T.StructField("gen", T.IntegerType()), own], salvage).filter(F.col("gen") >= gen).drop("gen")
        return self._read(f"state-{gen:08d}", [own], salvage).unionByName(tail) if gen else tail

    def salvage(self) -> tuple[DataFrame, DataFrame]:
        """What can still be read of a damaged store, as a log (key, seq, value) to write to another one, and a report
        (path, bytes, rows, lost) of its files. Nothing else reads around damage, and compaction least of all.

        A Parquet file is read whole or, where its end is gone, not at all. The report lists what lies there: a file
        that is missing altogether can't be named.
        """
        rows = self.log(salvage=True).withColumn("path", F.col("_metadata.file_path"))
        found = rows.groupBy("path").agg(F.count("*").alias("rows"))
        gen = self._generation()
        here = [p for p in (f"state-{gen:08d}" if gen else "", "log") if p and self._path(p)[1].exists(self._path(p)[0])]
        files = [self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.folder}/{p}").select(F.col("path"), F.col("length").alias("bytes")) for p in here]
        there = reduce(DataFrame.unionByName, files) if files else self.spark.createDataFrame([], "path string, bytes long")
        of = F.coalesce(F.regexp_extract("path", r"/log/gen=(\d+)/", 1).try_cast("int"), F.lit(gen))
        report = there.filter(of >= gen).join(found.withColumnRenamed("path", "seen"), F.expr("regexp_replace(path, '^file:/+', '/') = regexp_replace(seen, '^file:/+', '/')"), "left")
        return rows.select("key", "seq", "value"), report.select("path", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("rows").isNull().alias("lost"))

    def state(self) -> DataFrame:
        self._open()
        found = fold(self.log().drop("bucket"), self.config.combinator)
        if not self.config.cached:
            return found
        self.held.append(found.persist())
        return found

    def cached_rows(self) -> DataFrame:
        """What is held of states that were read; nothing unless the store is cached and was read since the last write."""
        kind = self.config.schema
        return self.held[-1] if self.held else self.spark.createDataFrame([], T.StructType([kind["key"], kind["value"]]))

    def ordered(self) -> DataFrame:
        """The state in the order of keys."""
        return self.state().orderBy("key")

    def _forget(self) -> None:
        """Frees cached states, which a write has made old."""
        for df in self.held:
            df.unpersist()
        self.held.clear()

    def point(self, key: int | str) -> DataFrame:
        """One key's row, from its bucket's files alone, and from none if the store's filter lacks the key."""
        own = key64(F.lit(key)) if isinstance(key, str) else F.lit(key).cast("long")
        if self.config.bloom and not self.might_contain(self.spark.range(1).select(own.alias("key"))).filter("present").head(1):
            return self.spark.createDataFrame([], T.StructType([self.config.schema["key"], self.config.schema["value"]]))
        rows = self.log().filter((F.col("bucket") == bucket(own)) & (F.col("key") == own)).drop("bucket")
        return fold(rows, self.config.combinator)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """The rows of requested keys that are there. With a filter, only buckets and keys that may be there are read and folded."""
        asked = keys.select("key")
        if self.config.bloom:
            asked = asked.join(self.might_contain(asked).filter("present").select("key"), "key", "left_semi")
        some = self.log().join(asked.distinct().withColumn("bucket", bucket(F.col("key"))), ["bucket", "key"], "left_semi").drop("bucket")
        return asked.join(fold(some, self.config.combinator), "key")

    # --- the filter of keys

    def bloom(self, fpp: float = 0.001, most_fpp: float = 0.02) -> DataFrame:
        """The words (check_sum, hashes, bits, word, mask) of a bloom filter of the keys of the flushed log.

        The check sum names the generation and the number of its rows; a filter of another check sum is not valid, and a new
        one is written, sized by the rows. One whose expected share of false positives is over ``most_fpp`` is written anew too.
        """
        n = self.log().count()
        check = f"{self._generation()}-{n}"
        path, fs = self._path(f"bloom-{check}/_SUCCESS")
        target = f"{self.folder}/bloom-{check}"
        if fs.exists(path):
            words = self.spark.read.parquet(target)
            if (sketches.words_fpp(words).first()["fpp"] or 0.0) <= most_fpp:
                return words
        old = [f.getPath() for f in fs.globStatus(self._path("bloom-*")[0]) or [] if f.getPath().getName() != f"bloom-{check}"]
        size = sketches.Size.of(max(n, 1), fpp)
        sketches.with_check_sum(sketches.words_of(sketches.bits_of(self.log(), size)), size, check).write.mode("overwrite").parquet(target)
        for each in old:
            fs.delete(each, True)
        return self.spark.read.parquet(target)

    def might_contain(self, keys: DataFrame) -> DataFrame:
        """(key, present) of the distinct requested keys by the filter: no key that was written is missed."""
        return sketches.words_contain(self.bloom(), keys)

    def compact(self) -> DataFrame:
        """Writes the folded state, ranged by bucket and key and sorted, so that filters on keys skip files and row groups,
        and returns it.

        Where the combinator is closed, each row carries the last seq of its key and the state replaces the log. A failure
        before the end leaves the former generation in use. Readers of the former generation may go on until the next
        compaction, which deletes it. Other states are only written to be read.
        """
        self._open()
        if not self.config.combinator.closed:
            target = f"{self.folder}/view-{uuid.uuid4().hex}"
            self.state().repartitionByRange("key").sortWithinPartitions("key").write.parquet(target)
            return self.spark.read.parquet(target)
        gen = self._generation() + 1
        log = self.log().drop("bucket")
        rows = _with_last_seq(log, self.config).withColumn("bucket", bucket(F.col("key")))
        target = f"{self.folder}/state-{gen:08d}"
        rows.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").mode("overwrite").parquet(target)
        self._forget()
        for old in (f"state-{gen - 2:08d}", f"log/gen={gen - 2}"):
            path, fs = self._path(old)
            fs.delete(path, True)
        return self._read(f"state-{gen:08d}", []).select("key", "value")

    def drop(self) -> None:
        """Removes all data. The store stays, unless it is temporary."""
        self.pending.clear()
        self._forget()
        path, fs = self._path("*")
        for f in fs.globStatus(path) or []:
            if self.config.temporary or f.getPath().getName() != "config.json":
                fs.delete(f.getPath(), True)
        if self.config.temporary:
            fs.delete(self._path("")[0], True)
        for tell in self.listeners:
            tell("dropped", None)

    def close(self) -> None:
        if not self.closed and self.config.temporary:
            self.drop()
        self._forget()
        self.closed = True

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()


@dataclass
class MemoryStore(Store):
    """A store in the executors' memory, always temporary, that combines what it holds at each flush."""

    def __post_init__(self) -> None:
        self.config = replace(self.config, temporary=True)
        self.rows = self.spark.createDataFrame([], self.config.schema)
        self.flushes = 0

    def flush(self) -> Store:
        self._open()
        written, self.pending = self.pending, []
        if written:
            before, rows = self.rows, reduce(DataFrame.unionByName, [self.rows, *written])
            if self.config.combinator.closed:
                rows = _with_last_seq(rows, self.config)
            self.flushes += 1
            if self.flushes % 16 == 0 and self.spark.conf.get("spark.checkpoint.dir", None):
                rows = rows.checkpoint()  # else its plan would hold all writes there ever were
            self.rows = rows.persist()
            self.rows.count()
            before.unpersist()
        self._tell(written)
        return self

    def log(self, salvage: bool = False) -> DataFrame:
        self._open()
        return self.rows.withColumn("bucket", bucket(F.col("key")))

    def compact(self) -> DataFrame:
        return self.state()

    def bloom(self, fpp: float = 0.001, most_fpp: float = 0.02) -> DataFrame:
        size = sketches.Size.of(max(self.log().count(), 1), fpp)
        return sketches.with_check_sum(sketches.words_of(sketches.bits_of(self.log(), size)), size, "memory")

    def drop(self) -> None:
        self.pending.clear()
        self._forget()
        self.rows.unpersist()
        self.rows = self.spark.createDataFrame([], self.config.schema)
        for tell in self.listeners:
            tell("dropped", None)


def _with_last_seq(log: DataFrame, config: StoreConfig) -> DataFrame:
    """The folded log as (key, seq, value) with the last seq of each key."""
    last = log.groupBy(F.col("key").alias("__key")).agg(F.max("seq").alias("seq"))
    found = fold(log, config.combinator)
    return found.join(last, found["key"].eqNullSafe(last["__key"])).select(*[F.col(f.name).cast(f.dataType) for f in config.schema])


@dataclass
class IdStore:
    """Objects by their own string id. They lie under the hash of the id; two ids of one hash stay apart.

    ``fields`` is the type of the objects without the id, and ``inner`` combines those of one id.
    """

    store: Store

    @classmethod
    def create(cls, catalog: Catalog, name: str, fields: str, inner: Combinator = combinators.OVERWRITE, **more) -> IdStore:
        kind = T.StructType([T.StructField("id", T.StringType()), T.StructField("body", T._parse_datatype_string(fields))])
        return cls(catalog.create(StoreConfig(name, kind, combinators.ids(inner), **more)))

    @property
    def fields(self) -> list[str]:
        return self.store.config.schema["value"].dataType["body"].dataType.names

    def write(self, rows: DataFrame) -> IdStore:
        """Buffers (id, seq, and the fields)."""
        return self._write(rows, F.struct(*self.fields))

    def remove(self, ids: DataFrame) -> IdStore:
        """Buffers the removal of (id, seq)."""
        return self._write(ids, F.lit(None))

    def _write(self, rows: DataFrame, body) -> IdStore:
        kind = self.store.config.schema["value"].dataType["body"].dataType
        self.store.write(rows.select(key64(F.col("id")).alias("key"), "seq", F.struct("id", body.cast(kind).alias("body")).alias("value")))
        return self

    def flush(self) -> IdStore:
        self.store.flush()
        return self

    def compact(self) -> DataFrame:
        return self._flat(self.store.compact())

    def _flat(self, state: DataFrame) -> DataFrame:
        return state.select("value.id", "value.body.*")

    def read(self, id_: str) -> DataFrame:
        """The object of an id, from its bucket's files alone."""
        return self._flat(self.store.point(id_)).filter(F.col("id") == F.lit(id_))

    def scan(self, predicate=None) -> DataFrame:
        """All objects, or those that pass."""
        rows = self._flat(self.store.state())
        return rows if predicate is None else rows.filter(predicate)

    def close(self) -> None:
        self.store.close()


@dataclass
class MaintainedIndex:
    """A secondary index kept in a store of its own: each flush of ``base`` adds the index keys of what was written.

    ``indexer`` gives an array of longs or strings for a value. Entries are only added; a read takes the keys entered under an index key and keeps
    those whose present value still has it, so an overwritten or removed value leaves no posting. The base must
    be one where the last write wins, as the index keys of a sum are not those of its terms.
    """

    base: Store
    indexer: Callable
    entries: Store

    @classmethod
    def on(cls, catalog: Catalog, base: Store, name: str, indexer: Callable) -> MaintainedIndex:
        if base.config.combinator.name != "overwrite":
            raise ValueError("an index can be maintained where the last write wins")
        found = cls(base, indexer, catalog.create(StoreConfig(name, "struct<k:bigint>", combinators.ENTRIES, temporary=base.config.temporary, in_memory=base.config.in_memory)))
        base.listeners.append(found._heard)
        return found

    def _heard(self, kind: str, rows: DataFrame | None) -> None:
        if kind == "updated":
            self._add(rows)
        elif kind == "flushed":
            self.entries.flush()
        elif kind == "dropped":
            self.entries.drop()

    def _add(self, rows: DataFrame) -> None:
        keys = rows.filter("value is not null").select(F.explode(F.array_distinct(self.indexer(F.col("value")))).alias("ikey"), F.col("key").alias("k"), "seq")
        if dict(keys.dtypes)["ikey"] == "string":
            keys = keys.withColumn("ikey", key64(F.col("ikey")))
        self.entries.write(keys.select(F.col("ikey").alias("key"), "seq", F.struct("k").alias("value")))

    def rebuild(self) -> None:
        """Enters all of the base's present state anew, as for a base that was there before the index."""
        self.entries.drop()
        self._add(self.base.state().withColumn("seq", F.lit(0).cast("long")))
        self.entries.flush()

    def postings(self, ikey: int | str) -> DataFrame:
        """(key, value) of the rows with an index key."""
        asked = self.entries.point(ikey).select(F.col("value.k").alias("key")).distinct()
        return self.base.multi_get(asked).filter(F.array_contains(self.indexer(F.col("value")), F.lit(ikey)))

    def by_example(self, example) -> DataFrame:
        """The rows that share any index key with the example, each once."""
        own = self.indexer(F.lit(example))
        keys = self.base.spark.range(1).select(F.explode(F.array_distinct(own)).alias("key"))
        if dict(keys.dtypes)["key"] == "string":
            keys = keys.withColumn("key", key64(F.col("key")))
        asked = self.entries.multi_get(keys).select(F.col("value.k").alias("key")).distinct()
        return self.base.multi_get(asked).filter(F.arrays_overlap(self.indexer(F.col("value")), own))


def escaped(name: str) -> str:
    """A name as one of a folder, from which it can be told: all but letters, digits, _ and - as ~ and two hexadecimal digits a byte."""
    return "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "".join(f"~{b:02X}" for b in c.encode()) for c in name)


def unescaped(folder: str) -> str:
    first, *rest = folder.split("~")
    return b"".join([first.encode(), *(bytes.fromhex(x[:2]) + x[2:].encode() for x in rest)]).decode()


class Catalog:
    """Stores under one folder, by name. What a store holds is written beside it, and checked when it is opened again."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.stores = spark, folder, {}

    def create(self, config: StoreConfig) -> Store:
        name = escaped(config.name)
        place = f"tmp/{name}_{uuid.uuid4().hex}" if config.temporary else name
        kind = MemoryStore if config.in_memory else Store
        store = kind(self.spark, config, f"{self.folder}/{place}")
        if not config.temporary and not config.in_memory:
            self._agree(store)
        self.stores[config.name] = store
        return store

    def _agree(self, store: Store) -> None:
        path, fs = store._path("config.json")
        own = {"value": store.config.schema["value"].dataType.jsonValue(), "combinator": store.config.combinator.name}
        if fs.exists(path):
            there = json.loads(self.spark.read.text(f"{store.folder}/config.json", wholetext=True).first()[0])
            if there != own:
                raise ValueError(f"store {store.config.name} holds {there['value']} combined by {there['combinator']}")
            return
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(own).encode()))
        out.close()

    def counts(self, name: str, temporary: bool = False, cached: bool = False, in_memory: bool = False, bloom: bool = False) -> Store:
        return self.create(StoreConfig(name, "long", combinators.LONG, cached, temporary, bloom, in_memory))

    def names(self) -> list[str]:
        """The stores that are open here."""
        return sorted(n for n, s in self.stores.items() if not s.closed)

    def stored(self) -> list[str]:
        """The lasting stores of the folder, whoever made them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/*/config.json")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(unescaped(f.getPath().getParent().getName()) for f in found)

    def close(self) -> None:
        for s in self.stores.values():
            s.close()


def in_memory(spark: SparkSession, rows: list[tuple], config: StoreConfig) -> DataFrame:
    """A log of (key, seq, value) from Python values, kept in memory."""
    return spark.createDataFrame(rows, config.schema).persist()
