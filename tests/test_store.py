"""Stores on disk, files, streams, and the catalogue against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyforge.operators import combinators as C
from tallyforge.operators.fold import fold
from tallyforge.plans import catalogue
from tallyforge.sources import files
from tallyforge.functions import text
from tallyforge.sources.store import Catalog, IdStore, MaintainedIndex, StoreConfig, escaped, in_memory, unescaped
from tallyforge.streaming.incremental import complete_fold, maintain_sums, read_sums

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(spark, values):
    return spark.createDataFrame(values, "key long, seq long, value long")


def test_write_flush_read(spark, tmp_path):
    told = []
    with Catalog(spark, str(tmp_path)).counts("c") as store:
        store.listeners.append(lambda kind, _: told.append(kind))
        store.write(rows(spark, [(42, 0, 10)]))
        assert store.log().count() == 0  # not before flush
        store.flush()
        store.write(rows(spark, [(42, 1, 1), (7, 2, 3)])).remove(spark.createDataFrame([(7, 3)], "key long, seq long")).flush()
        assert {r["key"]: r["value"] for r in store.state().collect()} == {42: 11}
        assert store.point(42).first()["value"] == 11 and not store.point(7).head(1)
        assert "bucket" in store.point(42)._jdf.queryExecution().executedPlan().toString()
        small = store.compact()
        assert small.exceptAll(store.state()).count() == 0 == store.state().exceptAll(small).count()
        store.drop()
        assert store.state().count() == 0
    assert told == ["updated", "flushed", "updated", "updated", "flushed", "dropped"]
    with pytest.raises(RuntimeError):
        store.state()


@pytest.mark.parametrize("combinator", [C.LONG, C.OVERWRITE])
def test_compaction_replaces_the_log(spark, tmp_path, combinator):
    """Writes, tombstones and repeated compactions give what the fold of the whole log gives; old generations go."""
    config = StoreConfig("c", "long", combinator, cached=True)
    parts = [[(1, 0, 5), (2, 1, 1), (3, 2, 9), (-(2**63), 3, 4), (None, 3, 8)], [(1, 4, None), (1, 5, 3), (2, 6, 2)], [(3, 7, None), (4, 8, 1)], [(3, 9, 6), (1, 10, 1)]]
    store = Catalog(spark, str(tmp_path)).create(config)
    for n, part in enumerate(parts):
        store.write(rows(spark, part[:1])).write(rows(spark, part[1:])).flush()
        want = {tuple(r) for r in fold(rows(spark, sum(parts[: n + 1], [])), combinator).collect()}
        assert {tuple(r) for r in store.state().collect()} == want
        if n != 1:
            assert {tuple(r) for r in store.compact().collect()} == want
        assert {tuple(r) for r in Catalog(spark, str(tmp_path)).create(config).state().collect()} == want
        assert {tuple(r) for r in store.point(1).collect()} == {r for r in want if r[0] == 1}
    assert sorted(p.name for p in (tmp_path / "c").glob("state-*")) == ["state-00000002", "state-00000003"]
    (tmp_path / "c" / "state-00000004").mkdir()  # a compaction that failed
    assert {tuple(r) for r in store.state().collect()} == want
    assert {tuple(r) for r in store.compact().collect()} == want


def test_compaction_of_open_states(spark, tmp_path):
    store = Catalog(spark, str(tmp_path)).create(StoreConfig("h", "array<long>", C.compact_index(100)))
    frame = spark.createDataFrame([(1, 0, [1, 2])], "key long, seq long, value array<long>")
    store.write(frame).flush()
    assert store.compact().first()["value"]["members"] == [1, 2]
    store.write(frame.withColumn("value", F.array(F.lit(3).cast("long")))).flush()
    assert store.state().first()["value"]["members"] == [1, 2, 3]


def test_string_keys_and_reopen(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    store = catalog.counts("logins")
    store.increase(spark.createDataFrame([("user_1", 0), ("user_1", 1)], "key string, seq long")).flush()
    assert Catalog(spark, str(tmp_path)).counts("logins").point("user_1").first()["value"] == 2
    temporary = catalog.counts("t", temporary=True)
    temporary.write(rows(spark, [(1, 0, 1)])).flush()
    catalog.close()
    assert catalog.names() == [] and not list((tmp_path / "tmp").glob("*/log"))


def test_config(spark):
    with pytest.raises(ValueError):
        StoreConfig("", "long")
    with pytest.raises(ValueError):
        StoreConfig("x", None)
    assert in_memory(spark, [(1, 0, 2)], StoreConfig("m", "long", C.LONG)).count() == 1


def test_names(spark, tmp_path):
    for name in ("a b", "a_b", "..", "a/b", "é~1", "a.b"):
        assert unescaped(escaped(name)) == name and not set(escaped(name)) & set("./ ")
    catalog = Catalog(spark, str(tmp_path / "c"))
    for name in ("a b", "a_b", ".."):
        catalog.counts(name).write(rows(spark, [(len(name), 0, 1)])).flush()
    assert [catalog.counts(n).state().count() for n in ("a b", "a_b", "..")] == [1, 1, 1]
    catalog.counts("..").drop()
    assert catalog.counts("a b").state().count() == 1 and catalog.counts("..").state().count() == 0
    assert Catalog(spark, str(tmp_path / "c")).stored() == ["..", "a b", "a_b"]
    with pytest.raises(ValueError):
        catalog.create(StoreConfig("a b", "string"))


def test_a_damaged_file_is_an_error_and_can_be_salvaged(spark, tmp_path):
    store = Catalog(spark, str(tmp_path)).counts("c")
    store.write(spark.range(10_000).select(F.col("id").alias("key"), F.lit(0).alias("seq"), F.lit(1).alias("value"))).flush()
    victim = sorted((tmp_path / "c" / "log").rglob("*.parquet"))[5]
    n = spark.read.parquet(str(victim)).count()
    victim.write_bytes(victim.read_bytes()[:-100])  # truncated
    for crc in victim.parent.glob(".*.crc"):
        crc.unlink()
    for read in (lambda: store.state().count(), store.compact):
        with pytest.raises(Exception, match="(?i)parquet|corrupt|footer|FAILED_READ"):
            read()
    assert not list((tmp_path / "c").glob("state-*/_SUCCESS"))  # nothing was replaced
    left, report = store.salvage()
    assert left.count() == 10_000 - n >= 5000
    told = report.collect()
    assert len(told) == len(list((tmp_path / "c" / "log").rglob("*.parquet"))) and sum(r["rows"] for r in told) == 10_000 - n
    assert [r["path"].endswith(victim.name) for r in told if r["lost"]] == [True]
    again = Catalog(spark, str(tmp_path)).counts("d")
    assert again.write(left).flush().state().count() == 10_000 - n


def test_lost_markers_lose_no_rows(spark, tmp_path):
    store = Catalog(spark, str(tmp_path)).counts("c")
    store.write(rows(spark, [(1, 0, 5), (2, 0, 1)])).flush().compact()
    store.write(rows(spark, [(1, 1, 2)])).flush()
    (tmp_path / "c" / "state-00000001" / "_SUCCESS").unlink()
    assert {tuple(r) for r in store.state().collect()} == {(1, 7), (2, 1)}


def test_bloom_layer(spark, tmp_path):
    store = Catalog(spark, str(tmp_path)).counts("c", bloom=True)
    store.write(rows(spark, [(i, 0, 1) for i in range(0, 2000, 2)])).flush()
    found = store.might_contain(spark.range(2000).withColumnRenamed("id", "key"))
    assert found.filter("not present and key % 2 = 0").count() == 0 and found.filter("present and key % 2 = 1").count() < 20
    first = sorted(p.name for p in (tmp_path / "c").glob("bloom-*"))
    assert first == ["bloom-0-1000"]
    assert store.point(4).first()["value"] == 1 and not store.point(10**9).head(1) and store.point(10**9).columns == ["key", "value"]
    store.write(rows(spark, [(7, 1, 3)])).flush()  # the filter is out of date and made anew
    assert store.point(7).first()["value"] == 3 and [p.name for p in (tmp_path / "c").glob("bloom-*")] == ["bloom-0-1001"]
    store.compact()
    asked = spark.createDataFrame([(7,), (7,), (4,), (5,)], "key long")
    assert sorted(tuple(r) for r in store.multi_get(asked).collect()) == [(4, 1), (7, 3), (7, 3)]
    empty = Catalog(spark, str(tmp_path)).counts("e", bloom=True)
    assert empty.multi_get(asked).count() == 0 and not empty.point(1).head(1)


def test_memory_store(spark, tmp_path):
    told = []
    with Catalog(spark, str(tmp_path)).counts("m", in_memory=True, bloom=True) as store:
        store.listeners.append(lambda kind, _: told.append(kind))
        store.write(rows(spark, [(1, 0, 5), (2, 0, 1)])).flush()
        store.write(rows(spark, [(1, 1, 2), (2, 1, None), (3, 1, 1)])).flush()
        assert {tuple(r) for r in store.state().collect()} == {(1, 7), (3, 1)} == {tuple(r) for r in store.compact().collect()}
        assert store.log().count() == 2 and store.point(1).first()["value"] == 7 and not store.point(2).head(1)
        store.drop()
        assert store.state().count() == 0
    assert told == ["updated", "flushed", "updated", "flushed", "dropped", "dropped"] and not list(tmp_path.rglob("*.parquet"))
    seqs = Catalog(spark, str(tmp_path)).create(StoreConfig("o", "string", in_memory=True))
    frame = lambda v: spark.createDataFrame(v, "key long, seq long, value string")
    seqs.write(frame([(1, 5, "b")])).flush().write(frame([(1, 4, "a")])).flush()
    assert seqs.state().first()["value"] == "b"


@pytest.mark.parametrize("in_memory_", [False, True])
def test_id_store(spark, tmp_path, in_memory_):
    store = IdStore.create(Catalog(spark, str(tmp_path)), "users", "first string, last string", C.last_non_empty(["first", "last"]), in_memory=in_memory_)
    frame = lambda v: spark.createDataFrame(v, "id string, seq long, first string, last string")
    store.write(frame([("my-id", 0, "Ann", None), ("other", 0, "Bo", "Zed")])).flush()
    store.write(frame([("my-id", 1, None, "Smith")])).flush().compact()
    store.write(frame([("my-id", 2, "Joan", None)])).flush()
    assert tuple(store.read("my-id").first()) == ("my-id", "Joan", "Smith")
    assert [r["id"] for r in store.scan(F.col("last") == "Zed").collect()] == ["other"] and store.scan().count() == 2
    store.remove(spark.createDataFrame([("my-id", 3)], "id string, seq long")).flush()
    assert not store.read("my-id").head(1) and store.scan().count() == 1 and not store.read("none").head(1)


@pytest.mark.parametrize("in_memory_", [False, True])
def test_maintained_index(spark, tmp_path, in_memory_):
    catalog = Catalog(spark, str(tmp_path))
    frame = lambda v: spark.createDataFrame(v, "key long, seq long, value string")
    texts = catalog.create(StoreConfig("texts", "string", in_memory=in_memory_))
    kept = MaintainedIndex.on(catalog, texts, "tokens", text.tokens)
    texts.write(frame([(1, 0, "This is a test"), (2, 0, "Negative example")])).flush()
    assert [r["key"] for r in kept.postings("this").collect()] == [1] and not kept.postings("yolo").head(1)
    assert [r["key"] for r in kept.by_example("another TEST").collect()] == [1]
    texts.write(frame([(3, 1, "yolo and this stuff"), (1, 2, "changed"), (2, 2, None)])).flush()
    assert [r["key"] for r in kept.postings("this").collect()] == [3] and not kept.postings("negative").head(1)
    if not in_memory_:  # opened again
        catalog = Catalog(spark, str(tmp_path))
        texts = catalog.create(StoreConfig("texts", "string"))
        kept = MaintainedIndex.on(catalog, texts, "tokens", text.tokens)
        texts.compact(), kept.entries.compact()
        texts.write(frame([(4, 3, "hi there")])).flush()
        assert [r["key"] for r in kept.postings("there").collect()] == [4] and [r["key"] for r in kept.postings("yolo").collect()] == [3]
    kept.rebuild()
    assert [r["key"] for r in kept.postings("changed").collect()] == [1]
    texts.drop()
    assert kept.entries.log().count() == 0
    with pytest.raises(ValueError):
        MaintainedIndex.on(catalog, catalog.counts("n"), "x", text.tokens)


def test_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("test\nline")
    assert files.byte_files(spark, str(tmp_path / "f")).first()["length"] == 9
    assert [r[0] for r in files.lines(spark, str(tmp_path / "f")).collect()] == ["test", "line"]
    files.store_object(spark.createDataFrame([(1, "é")], "a long, b string"), str(tmp_path / "o"))
    assert tuple(files.read_object(spark, str(tmp_path / "o"), "a long, b string").first()) == (1, "é")
    for n in (0, 2):
        with pytest.raises(ValueError):
            files.store_object(spark.range(n), str(tmp_path / "p"))
    assert files.uniform_stream(spark, 100, 10).agg(F.max("key")).first()[0] < 10


def test_stream_equals_batch(spark, tmp_path):
    parts = [[(1, 0, 5), (2, 1, 1)], [(1, 2, None), (1, 3, 3)], [(2, 4, None), (3, 5, 9)]]
    for i, part in enumerate(parts):
        rows(spark, part).coalesce(1).write.parquet(f"{tmp_path}/log/p{i}")
    seen = []
    stream = spark.readStream.schema("key long, seq long, value long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log/*")
    got = maintain_sums(spark, stream, f"{tmp_path}/state", lambda r, n: seen.append(r.count()))
    batch = fold(rows(spark, sum(parts, [])), C.LONG)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.collect()} == {(1, 3), (3, 9)}
    assert sum(seen) == 6
    wide = complete_fold(spark.readStream.schema("key long, seq long, value long").parquet(f"{tmp_path}/log/*"), F.max_by("value", "seq"))
    query = wide.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("w").filter("value is not null").collect()} == {(1, 3), (3, 9)}


def test_stream_run_again(spark, tmp_path):
    """Runs without new data change nothing, later data is added, and only two versions are kept; a rhythm gives a running query."""
    schema = "key long, seq long, value long"
    source = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/log/*")
    want = {}
    for i in range(4):
        rows(spark, [(1, i, 1), (64 + i, i, 5)]).coalesce(1).write.parquet(f"{tmp_path}/log/p{i}")
        want = {1: i + 1, **{64 + j: 5 for j in range(i + 1)}}
        for _ in range(2):
            assert {r["key"]: r["value"] for r in maintain_sums(spark, source(), f"{tmp_path}/s").collect()} == want
    assert len(list((tmp_path / "s").glob("version-*.json"))) == 2
    assert len(list((tmp_path / "s").glob("data-*"))) == 3  # the first batch holds a bucket that later ones left alone
    rows(spark, [(1, 9, None)]).coalesce(1).write.parquet(f"{tmp_path}/log/p9")
    running = maintain_sums(spark, source(), f"{tmp_path}/s", every="100 milliseconds")
    running.processAllAvailable()
    running.stop()
    want.pop(1)
    assert {r["key"]: r["value"] for r in read_sums(spark, f"{tmp_path}/s").collect()} == want
    assert read_sums(spark, f"{tmp_path}/none").count() == 0


def comparable(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in catalogue.ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = found.fetchall()
    assert comparable(df.columns, got) == comparable(columns, want)
    assert want or name == "empty_filter"


def test_entry(spark):
    assert __spark_entry__.entry(spark).head(1)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
