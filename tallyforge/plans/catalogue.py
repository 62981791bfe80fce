"""Queries over the driver's tables, one or more for each operator, and DuckDB SQL with the same results.

Logs: ``events`` with key user_id, seq event_id and value floor(value); where tombstones are wanted, clicks are.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import combinators as C
from ..operators import index, ranking, reads, sketches
from ..operators.fold import fold, ordered_fold
from ..sources import files
from ..sources.files import bigram_stream, spread
from ..sources.store import Catalog, IdStore, MaintainedIndex, StoreConfig

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_log(spark: SparkSession, d: str, tombstones: bool) -> DataFrame:
    value = F.floor("value").cast("long")
    value = F.when(F.col("event_type") != "click", value) if tombstones else value
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), value.alias("value"))


def order_store(spark: SparkSession, d: str) -> DataFrame:
    """(key, value): the state of a log of orders with prices in whole units. Every tenth order is first written with another price."""
    price = F.floor("o_totalprice").cast("long")
    first = F.when(F.col("o_orderkey") % 10 == 0, F.array(-price, price)).otherwise(F.array(price))
    log = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.posexplode(first).alias("seq", "value"))
    return fold(log, C.OVERWRITE)


LOG = "SELECT user_id AS key, event_id AS seq, CAST(floor(value) AS BIGINT) AS value, event_type FROM events"
TOMB = "SELECT user_id AS key, event_id AS seq, CASE WHEN event_type <> 'click' THEN CAST(floor(value) AS BIGINT) END AS value FROM events"
ORDERS = "SELECT o_orderkey AS key, CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders"
KEY64 = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
BIGRAMS = "SELECT t[i] || ' ' || t[i + 1] AS key FROM (SELECT string_split(lower(text), ' ') AS t FROM documents), range(1, len(t)) r(i)"


@query(f"SELECT key AS bigram, count(*) AS n FROM ({BIGRAMS}) GROUP BY key")
def bigram_counts(spark, d):
    """S10, X5, W4, A1, T1."""
    counts = fold(bigram_stream(table(spark, d, "documents")).withColumn("value", F.lit(1)).withColumn("seq", F.lit(0)), C.LONG, tombstones=False)
    return ranking.ranked(counts.select(F.col("key").alias("bigram"), F.col("value").alias("n")), "bigram", "n")


@query(f"SELECT key AS bigram, count(*) AS n FROM ({BIGRAMS}) GROUP BY key ORDER BY n DESC, bigram LIMIT 100")
def bigram_topk(spark, d):
    """T1 with a limit."""
    counts = bigram_stream(table(spark, d, "documents")).groupBy("key").agg(F.count("*").alias("n"))
    return ranking.ranked(counts.select(F.col("key").alias("bigram"), "n"), "bigram", "n", 100)


@query("SELECT 'user_' || user_id || '_logged_in' AS counter, count(*) AS n FROM events GROUP BY 1")
def login_counts(spark, d):
    """W2, W4, A1."""
    log = table(spark, d, "events").select(F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit("_logged_in")).alias("key"), F.col("event_id").alias("seq"), F.lit(1).alias("value"))
    return fold(log, C.LONG, tombstones=False).select(F.col("key").alias("counter"), F.col("value").alias("n"))


@query("SELECT key, CAST(sum(value) AS INTEGER) AS total FROM (" + LOG + ") GROUP BY key")
def sum_int(spark, d):
    """A2."""
    return fold(event_log(spark, d, False), C.INTEGER).withColumnRenamed("value", "total")


@query("SELECT l_orderkey AS key, CAST(sum(CAST(l_quantity AS DOUBLE)) AS FLOAT) AS total FROM lineitem GROUP BY 1")
def sum_float(spark, d):
    """A3; whole quantities add exactly in any order."""
    log = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("value"))
    return fold(log, C.FLOAT).withColumnRenamed("value", "total")


@query("SELECT l_suppkey AS key, round(sum(l_extendedprice), 1) AS total FROM lineitem GROUP BY 1")
def sum_double(spark, d):
    """A4, rounded as the order of addition is free."""
    log = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("seq"), F.col("l_extendedprice").alias("value"))
    return fold(log, C.DOUBLE).select("key", F.round("value", 1).alias("total"))


@query(f"WITH l AS ({TOMB}) SELECT key, CAST(sum(value) AS BIGINT) AS total FROM l WHERE value IS NOT NULL AND seq > coalesce((SELECT max(seq) FROM l t WHERE t.key = l.key AND t.value IS NULL), -1) GROUP BY key")
def fold_tombstone_sum(spark, d):
    """A0, W5."""
    return fold(event_log(spark, d, True), C.LONG).withColumnRenamed("value", "total")


@query(f"WITH l AS ({TOMB}) SELECT key, arg_max_null(value, seq) AS value FROM l GROUP BY key HAVING arg_max_null(value, seq) IS NOT NULL")
def last_write_wins(spark, d):
    """A5 with tombstones."""
    return fold(event_log(spark, d, True), C.OVERWRITE)


@query("""SELECT user_id AS key, arg_max(event_type, event_id) FILTER (event_type <> '') AS event_type,
  arg_max(props, event_id) FILTER (props <> '') AS props FROM events GROUP BY 1""")
def user_field_merge(spark, d):
    """A18, A13, I10."""
    log = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.struct("event_type", "props").alias("value"))
    return fold(log, C.last_non_empty(["event_type", "props"])).select("key", "value.event_type", "value.props")


@query(f"WITH l AS ({TOMB}) SELECT key, max(value) AS value FROM l WHERE value IS NOT NULL AND seq > coalesce((SELECT max(seq) FROM l t WHERE t.key = l.key AND t.value IS NULL), -1) GROUP BY key")
def custom_fold(spark, d):
    """The larger value, as an ordered fold."""
    return ordered_fold(event_log(spark, d, True), F.lit(None).cast("long"), lambda a, b: F.greatest(a, b))


@query("SELECT user_id AS key, event_type AS entry, count(*) AS n FROM events GROUP BY 1, 2")
def count_map_merge(spark, d):
    """A6."""
    log = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.create_map("event_type", F.lit(1)).alias("value"))
    return fold(log, C.COUNT_MAP).select("key", F.explode("value").alias("entry", "n"))


def _order_counts(spark, d, value: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.col(value).alias("n"), "l_orderkey")
    log = rows.select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("seq"), F.array(F.struct(F.col("l_partkey").alias("k"), F.col("n"))).alias("value"))
    return fold(log, C.COUNTS_LIST)


@query("SELECT l_suppkey AS key, l_partkey AS k, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")
def counts_list(spark, d):
    """A7, T2."""
    return _order_counts(spark, d, "l_linenumber").select("key", F.explode("value").alias("e")).select("key", "e.k", "e.n")


@query("SELECT l_suppkey AS key, l_partkey AS k, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2")
def counts_list_double(spark, d):
    """A8; quantities are whole."""
    return _order_counts(spark, d, "l_quantity").select("key", F.explode("value").alias("e")).select("key", "e.k", "e.n")


@query("SELECT l_suppkey AS key, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def counts_total(spark, d):
    """G4."""
    return _order_counts(spark, d, "l_linenumber").select("key", ranking.total(F.col("value")).alias("total"))


@query("SELECT l_suppkey AS key, CAST(coalesce(sum(l_linenumber) FILTER (l_partkey = 7), 0) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def counts_get(spark, d):
    """G5."""
    return _order_counts(spark, d, "l_linenumber").select("key", ranking.count_of(F.col("value"), F.lit(7)).alias("n"))


@query("SELECT DISTINCT l_orderkey AS key, l_partkey AS item FROM lineitem")
def long_list_union(spark, d):
    """A9, T6."""
    log = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("seq"), F.array("l_partkey").alias("value"))
    return fold(log, C.LONG_LIST).select("key", F.explode("value").alias("item"))


@query("SELECT DISTINCT user_id AS key, event_type AS item FROM events")
def string_set_union(spark, d):
    """A10."""
    log = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.array("event_type").alias("value"))
    return fold(log, C.STRING_SET).select("key", F.explode("value").alias("item"))


@query("SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, event_id AS doc, CAST(length(event_type) AS INTEGER) AS pos FROM events")
def postings_concat(spark, d):
    """A11."""
    log = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.array(F.struct(F.col("event_id").alias("doc"), F.length("event_type").alias("pos"))).alias("value"))
    return fold(log, C.POSTINGS).select("key", F.posexplode("value").alias("place", "e")).select("key", F.col("place").cast("long").alias("place"), "e.doc", "e.pos")


@query("SELECT l_partkey AS key, l_suppkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2")
def nested_key_merge(spark, d):
    """A12."""
    log = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("seq"), F.array(F.struct(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("long").alias("v"))).alias("value"))
    return fold(log, C.list_merge(C.LONG)).select("key", F.explode("value").alias("e")).select("key", "e.k", "e.v")


@query("SELECT c_name AS id, arg_max(c_acctbal, c_custkey) AS acctbal FROM customer GROUP BY 1")
def id_objects(spark, d):
    """Objects by their own string id; the last write wins."""
    log = table(spark, d, "customer").select(keys.key64(F.col("c_name")).alias("key"), F.col("c_custkey").alias("seq"), F.struct(F.col("c_name").alias("id"), F.col("c_acctbal").alias("acctbal")).alias("value"))
    return fold(log, C.by_id(C.OVERWRITE)).select(F.col("key").alias("id"), "value.acctbal")


@query(f"SELECT {KEY64.format('key')} AS key, count(*) AS n FROM ({BIGRAMS}) GROUP BY 1")
def object_counts(spark, d):
    """Objects with a hashed bigram and its count."""
    key = bigram_stream(table(spark, d, "documents")).select(keys.key64(F.col("key")).alias("key"))
    log = key.select("key", F.lit(0).alias("seq"), F.struct(F.col("key").alias("k"), F.lit(1).alias("n")).alias("value"))
    return fold(log, C.KEYED_COUNT, tombstones=False).select("key", "value.n")


@query(f"SELECT key, value FROM ({ORDERS}) WHERE key = 7")
def point_read(spark, d):
    """R1, R2."""
    return reads.point(order_store(spark, d), 7)


@query(f"SELECT c_custkey AS key, coalesce(n, 0) AS value FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def read_count_default(spark, d):
    """R3."""
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.lit(1).alias("value"))
    return reads.counts_of(fold(log, C.LONG, tombstones=False), table(spark, d, "customer").select(F.col("c_custkey").alias("key")))


@query(f"SELECT o.key, o.value FROM lineitem JOIN ({ORDERS}) o ON l_orderkey = o.key WHERE l_quantity > 49")
def multi_get(spark, d):
    """Requests repeat, missing keys are skipped."""
    asked = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("key"))
    return reads.multi_get(order_store(spark, d), asked).select("key", "value")


@query(ORDERS)
def full_scan(spark, d):
    """R5."""
    return order_store(spark, d)


@query("SELECT o_orderkey AS key FROM orders")
def keys_only(spark, d):
    """P1."""
    return reads.keys_only(order_store(spark, d))


@query(f"SELECT value FROM ({ORDERS})")
def values_only(spark, d):
    """P2."""
    return reads.values_only(order_store(spark, d))


@query(f"SELECT value FROM ({ORDERS}) WHERE value % 2 = 0")
def values_filtered(spark, d):
    """P3."""
    return reads.values_only(reads.where(order_store(spark, d), F.col("value") % 2 == 0))


@query(f"SELECT key, value FROM ({ORDERS}) WHERE key >= 100 AND key < 5000")
def key_range(spark, d):
    """F1, F2."""
    return reads.key_range(order_store(spark, d), 100, 5000)


@query(f"SELECT key, value FROM ({ORDERS}) WHERE key IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def key_set(spark, d):
    """F3 with a table of keys."""
    return reads.key_set(order_store(spark, d), table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key")))


@query(f"SELECT key, value FROM ({ORDERS}) WHERE key % 2 = 0")
def key_even(spark, d):
    """F4, Y2."""
    return reads.where(order_store(spark, d), F.col("key") % 2 == 0)


@query(f"SELECT key, value FROM ({ORDERS}) WHERE value % 2 = 0")
def value_even(spark, d):
    """F5, Y3."""
    return reads.where(order_store(spark, d), F.col("value") % 2 == 0)


@query("SELECT c_custkey AS key, c_custkey IN (SELECT o_custkey FROM orders) AS present FROM customer")
def membership(spark, d):
    """F6."""
    state = table(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    return reads.might_contain(state, table(spark, d, "customer").select(F.col("c_custkey").alias("key")))


@query("SELECT count(*) AS n FROM orders")
def exact_size(spark, d):
    """G1."""
    return reads.exact_size(order_store(spark, d))


@query("SELECT count(DISTINCT l_orderkey) AS n, true AS close FROM lineitem")
def appr_size(spark, d):
    """The exact size, and whether the estimate is within three times its error of it."""
    log = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    exact, near = log.distinct().agg(F.count("*").alias("n")), reads.approximate_size(log).withColumnRenamed("n", "estimate")
    return exact.join(F.broadcast(near)).select("n", (F.abs(F.col("estimate") - F.col("n")) <= 0.15 * F.col("n")).alias("close"))  # one row by one row


@query(f"SELECT CAST(sum(CAST('0x' || substr(md5(key || '|' || value), 1, 7) AS BIGINT)) AS BIGINT) AS checksum FROM ({ORDERS})")
def checksum(spark, d):
    """G3."""
    return reads.checksum(order_store(spark, d))


def _texts(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value")))


TOKENS = "SELECT DISTINCT doc_id AS key, text AS value, unnest(string_split(lower(text), ' ')) AS ikey FROM documents"


@query(f"SELECT ikey, key FROM ({TOKENS})")
def token_index(spark, d):
    """I1, X4, Y4."""
    return index.multi_index(_texts(spark, d), text.tokens)


@query(f"SELECT key, value FROM ({TOKENS}) WHERE ikey = 'that'")
def token_index_lookup(spark, d):
    """I2."""
    return index.postings(_texts(spark, d), text.tokens, "that")


@query(f"SELECT DISTINCT key, value FROM ({TOKENS}) WHERE ikey IN ('another', 'license', 'der')")
def query_by_example(spark, d):
    """I3."""
    return index.by_example(_texts(spark, d), text.tokens, "Another LICENSE der")


@query(f"SELECT DISTINCT key, value FROM ({TOKENS}) WHERE ikey >= 'z' AND ikey < '{{'")
def index_key_filter(spark, d):
    """I4, T5."""
    return index.by_index_key(_texts(spark, d), text.tokens, lambda t: (t >= "z") & (t < "{"))


def _customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))


@query(f"SELECT {KEY64.format('c_name')} AS ikey, c_custkey AS key, c_name AS value FROM customer WHERE c_custkey = 5")
def unique_index_lookup(spark, d):
    """By the index key of an example."""
    found = index.unique_index(_customers(spark, d), keys.key64)
    return found.join(_customers(spark, d).filter("key = 5").select(keys.key64(F.col("value")).alias("ikey")), "ikey")


@query(f"SELECT {KEY64.format('c_name')} AS ikey, c_custkey AS key, c_name AS value FROM customer WHERE {KEY64.format('c_name')} % 2 = 0")
def unique_index_scan(spark, d):
    """I7."""
    return index.unique_index(_customers(spark, d), keys.key64).filter("ikey % 2 = 0")


@query("SELECT l_suppkey AS key, arg_min(l_partkey, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey) AS value FROM lineitem GROUP BY 1")
def first_write_wins(spark, d):
    """The first value of a key whose primary key is the same throughout."""
    log = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("seq"), F.col("l_partkey").alias("value"), F.col("l_suppkey").alias("primary"))
    return fold(log, C.unique_first())


def _id_store(spark, d) -> IdStore:
    """Customers by name: written, compacted, and those with odd keys written anew with a balance of one more."""
    rows = table(spark, d, "customer").select(F.col("c_name").alias("id"), F.lit(0).cast("long").alias("seq"), F.col("c_acctbal").alias("acctbal"), F.col("c_custkey").alias("custkey"))
    store = IdStore.create(Catalog(spark, _shared_folder(spark, "stores")), "customers", "acctbal double, custkey bigint")
    store.write(rows).flush().compact()
    again = rows.filter("custkey % 2 = 1").withColumn("seq", F.lit(1).cast("long")).withColumn("acctbal", F.col("acctbal") + 1)
    gone = rows.filter("custkey % 5 = 0").select("id", F.lit(2).cast("long").alias("seq"))
    return store.write(again).remove(gone).flush()


CUSTOMERS = "SELECT c_name AS id, c_acctbal + c_custkey % 2 AS acctbal, c_custkey AS custkey FROM customer WHERE c_custkey % 5 <> 0"


@query(f"SELECT * FROM ({CUSTOMERS}) WHERE id = (SELECT c_name FROM customer WHERE c_custkey = 7)")
def id_read(spark, d):
    """One object of a store by its own id."""
    name = table(spark, d, "customer").filter("c_custkey = 7").first()
    return _id_store(spark, d).read(name["c_name"] if name else "")


@query(f"SELECT * FROM ({CUSTOMERS}) WHERE acctbal < 0")
def id_scan_filtered(spark, d):
    """I11."""
    return _id_store(spark, d).scan(F.col("acctbal") < 0)


@query("""SELECT key, k, row_number() OVER (PARTITION BY key ORDER BY n DESC, k) - 1 AS place FROM
  (SELECT l_suppkey AS key, l_partkey AS k, sum(l_linenumber) AS n FROM lineitem GROUP BY 1, 2)""")
def sorted_keys(spark, d):
    """T1 within lists."""
    found = _order_counts(spark, d, "l_linenumber").select("key", ranking.sorted_keys(F.col("value")).alias("ks"))
    return found.select("key", F.posexplode("ks").alias("place", "k")).select("key", "k", F.col("place").cast("long").alias("place"))


@query("""SELECT l_orderkey AS key, k, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) - 1 AS place FROM (SELECT DISTINCT l_orderkey, l_suppkey AS k FROM lineitem)""")
def sorted_distinct_keys(spark, d):
    """T3, T4."""
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_set("l_suppkey").alias("ks"))
    return found.select("key", F.posexplode(ranking.compact(F.col("ks"))).alias("place", "k")).select("key", "k", F.col("place").cast("long").alias("place"))


@query(f"SELECT DISTINCT key, length(value) AS size FROM ({TOKENS}) WHERE length(ikey) > 12")
def index_distinct(spark, d):
    """T5."""
    found = index.by_index_key(_texts(spark, d), text.tokens, lambda t: F.length(t) > 12)
    return found.select("key", F.length("value").cast("long").alias("size")).distinct()


#: Places of a key in a filter of {m} bits and {k} hashes, as keys.probes computes them.
PLACES = """SELECT key, (CASE WHEN x < 0 THEN -x - 1 ELSE x END) % {m} AS bit FROM (
  SELECT key, ((low + i * high + 2147483648) & 4294967295) - 2147483648 AS x FROM (
    SELECT key, CASE WHEN l = 0 THEN 1540483477 ELSE l END AS low, CASE WHEN h = 0 THEN 1540483477 ELSE h END AS high FROM (
      SELECT key, (((key & 4294967295) + 2147483648) & 4294967295) - 2147483648 AS l, (((key >> 32) + 2147483648) & 4294967295) - 2147483648 AS h FROM ({source}))), range(1, {k} + 1) r(i))"""
BLOOM = sketches.Size(1 << 18, 7)
NAMES = f"SELECT {KEY64.format('c_name')} AS key, c_custkey FROM customer"


def _places(source: str, size: sketches.Size = BLOOM) -> str:
    return PLACES.format(m=size.bits, k=size.hashes, source=source)


def _names(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(keys.key64(F.col("c_name")).alias("key"), "c_custkey")


@query(f"SELECT DISTINCT bit FROM ({_places(NAMES)})")
def bloom_bits(spark, d):
    """B1."""
    return sketches.bits_of(_names(spark, d), BLOOM)


@query(f"WITH b AS (SELECT DISTINCT bit FROM ({_places(NAMES + ' WHERE c_custkey % 2 = 0')})) SELECT key, bool_and(bit IN (SELECT bit FROM b)) AS present FROM ({_places(NAMES)}) GROUP BY key")
def bloom_probe(spark, d):
    """B2, F6, B10."""
    bits = sketches.bits_of(_names(spark, d).filter("c_custkey % 2 = 0"), BLOOM)
    return sketches.might_contain(bits, _names(spark, d), BLOOM)


@query(f"SELECT bit // 64 AS word, count(DISTINCT bit) AS bits FROM ({_places(NAMES)}) GROUP BY 1")
def bloom_merge(spark, d):
    """Two filters as words, merged by OR."""
    halves = [sketches.words_of(sketches.bits_of(_names(spark, d).filter(f"c_custkey % 2 = {i}"), BLOOM)) for i in (0, 1)]
    return sketches.merge_words(*halves).select("word", F.bit_count("mask").cast("long").alias("bits"))


@query(f"SELECT round(pow(count(DISTINCT bit) / {BLOOM.bits}.0::DOUBLE, {BLOOM.hashes}), 12) AS fpp FROM ({_places(NAMES)})")
def bloom_fpp(spark, d):
    """B3."""
    return sketches.expected_fpp(sketches.bits_of(_names(spark, d), BLOOM), BLOOM).select(F.round("fpp", 12).alias("fpp"))


COUNTING = sketches.Size(1 << 20, 4)
COUNTED = f"SELECT {KEY64.format('event_type || user_id')} AS key, count(*) AS n FROM events GROUP BY 1"


def _counted(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(keys.key64(F.concat("event_type", F.col("user_id").cast("string"))).alias("key")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS ({COUNTED}), p AS (SELECT DISTINCT key, bit FROM ({_places('SELECT key FROM c', COUNTING)})),
cells AS (SELECT bit, least(max(n), 255) AS n FROM p JOIN c USING (key) GROUP BY bit) SELECT key, CAST(min(n) AS BIGINT) AS n FROM p JOIN cells USING (bit) GROUP BY key""")
def counting_bloom(spark, d):
    """With the conservative update."""
    counted = _counted(spark, d)
    return sketches.max_count(sketches.cells_of(counted, COUNTING), counted, COUNTING)


@query(f"""WITH c AS ({COUNTED}), p AS (SELECT DISTINCT key, bit FROM ({_places('SELECT key FROM c', COUNTING)})),
half AS (SELECT key % 2 AS h, bit, least(max(n), 255) AS n FROM p JOIN c USING (key) GROUP BY ALL), cells AS (SELECT bit, least(sum(n), 255) AS n FROM half GROUP BY bit)
SELECT round(pow(count(*) / {COUNTING.bits}.0::DOUBLE, {COUNTING.hashes}), 15) AS fpp, CAST(sum(n) AS BIGINT) AS total FROM cells""")
def counting_bloom_merge(spark, d):
    """Two filters merged, their expected share of false positives and what their cells hold."""
    counted = _counted(spark, d)
    halves = [sketches.cells_of(counted.filter(F.col("key") % 2 == i), COUNTING) for i in (0, 1)]
    cells = sketches.merge_cells(*halves)
    return sketches.cells_fpp(cells, COUNTING).join(F.broadcast(cells.agg(F.sum("n").alias("total")))).select(F.round("fpp", 15).alias("fpp"), "total")  # one row by one row


def _part_sets(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("seq"), F.array("l_partkey").alias("value"))


def _members_found(log: DataFrame, state: DataFrame, *fields: str) -> DataFrame:
    """(key, fields, exact, found): how many of its members each set of the state has, each looked up in a row of its own."""
    asked = log.select("key", F.explode("value").alias("x")).distinct().withColumn("at", sketches.set_places(F.col("x"), 6000))
    read = asked.join(state, "key").select("key", *[f"value.{f}" for f in fields], F.col("value.members").isNotNull().alias("exact"), sketches.set_contains(F.col("value"), F.col("x"), 6000, F.col("at")).alias("in"))
    return read.groupBy("key", *fields, "exact").agg(F.count_if("in").alias("found")).select("key", *fields, "exact", "found")


@query("SELECT l_suppkey AS key, count(DISTINCT l_partkey) AS n, count(DISTINCT l_partkey) < 600 AS exact, count(DISTINCT l_partkey) AS found FROM lineitem GROUP BY 1")
def compact_index(spark, d):
    """Sets, exact while small; all members are found in either form."""
    log = _part_sets(spark, d)
    return _members_found(log, fold(log, C.compact_index(6000)), "n")


@query("""SELECT l_suppkey AS key, count(DISTINCT l_partkey) AS found,
  coalesce(count(DISTINCT l_partkey) FILTER (l_orderkey % 2 = 0), 0) < 600 AND coalesce(count(DISTINCT l_partkey) FILTER (l_orderkey % 2 = 1), 0) < 600 AND count(DISTINCT l_partkey) < 600 AS exact FROM lineitem GROUP BY 1""")
def compact_index_merge(spark, d):
    """Two states of sets, of even and of odd orders, merged; all members are found."""
    log = _part_sets(spark, d)
    halves = [fold(log.filter(F.col("seq") % 2 == i), C.compact_index(6000)) for i in (0, 1)]
    return _members_found(log, sketches.merge_hybrid_sets(*halves, 6000)).select("key", "found", "exact")


@query("""SELECT key, CAST(sum(n) AS BIGINT) AS total, count(*) < 600 AS exact, true AS enough FROM (SELECT l_suppkey AS key, l_partkey, sum(l_linenumber) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def compact_counts_index(spark, d):
    """Counts, exact while few; in either form no count that is read is too low."""
    log = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("seq"), F.array(F.struct(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("n"))).alias("value"))
    asked = _order_counts(spark, d, "l_linenumber").withColumnRenamed("value", "asked")
    state = fold(log, C.compact_counts(6000)).join(asked, "key")
    exact = F.col("value.counts").isNotNull()
    # a list is compared whole; of a filter each count is read in a row of its own
    reads_ = state.select("key", "value", exact.alias("exact"), F.when(exact, F.col("value.counts") == F.col("asked")).alias("same"), F.explode(F.when(exact, F.slice("asked", 1, 1)).otherwise(F.col("asked"))).alias("e"))
    reads_ = reads_.withColumn("at", sketches.set_places(F.col("e.k"), 6000))
    held = sketches.filter_count(F.col("value"), F.col("at"), 6000)
    return reads_.select("key", "value.total", "exact", F.coalesce("same", held >= F.least("e.n", F.lit(255))).alias("enough")).groupBy("key", "total", "exact").agg(F.bool_and("enough").alias("enough"))


LEVEL = "CAST(floor(log2(n) * 10) AS BIGINT) - 9"


@query(f"""WITH c AS ({COUNTED}), p AS (SELECT DISTINCT key, bit FROM ({_places('SELECT key FROM c', COUNTING)})), many AS (SELECT key, n, {LEVEL} AS level FROM c WHERE n > 1),
cells AS (SELECT bit, max(level) AS level FROM p JOIN many USING (key) GROUP BY bit), means AS (SELECT level, avg(n) AS average FROM many GROUP BY level),
singles AS (SELECT DISTINCT bit FROM ({_places('SELECT key FROM c WHERE n = 1')})), asked AS (SELECT key FROM c UNION SELECT key + 1 FROM c), q AS (SELECT DISTINCT key, bit FROM ({_places('SELECT key FROM asked', COUNTING)})),
found AS (SELECT key, min(coalesce(level, 0)) AS level FROM q LEFT JOIN cells USING (bit) GROUP BY key), one AS (SELECT key, bool_and(bit IN (SELECT bit FROM singles)) AS one FROM ({_places('SELECT key FROM asked')}) GROUP BY key)
SELECT key, CAST(level AS BIGINT) AS level, round(coalesce(average, CASE WHEN one THEN 1.0 ELSE 0.0 END), 6) AS approximate FROM found JOIN one USING (key) LEFT JOIN means USING (level)""")
def approx_counts(spark, d):
    """Counts read from the filters alone, of keys that were counted and of others."""
    counted = _counted(spark, d)
    found = sketches.counts_filter(counted, COUNTING, BLOOM)
    asked = counted.select("key").unionByName(counted.select((F.col("key") + 1).alias("key")))
    return sketches.approximate_count(found, asked).select("key", "level", F.round("approximate", 6).alias("approximate"))


@query("SELECT bit FROM (SELECT 0::BIGINT AS bit) WHERE false")
def empty_filter(spark, d):
    """The filter that merges with any other without a change."""
    return sketches.bits_of(_names(spark, d).filter("false"), BLOOM)


@query("SELECT c_custkey AS key, to_json({'value': {'c_name': c_name, 'c_acctbal': c_acctbal, 'c_mktsegment': c_mktsegment}})::VARCHAR AS json FROM customer")
def json_dump(spark, d):
    """S13, X6."""
    return reads.dump(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.struct("c_name", "c_acctbal", "c_mktsegment").alias("value")))


@query("SELECT c_custkey AS key, c_name, c_acctbal FROM customer")
def json_roundtrip(spark, d):
    """Encoded and decoded."""
    text_ = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.to_json(F.struct("c_name", "c_acctbal")).alias("j"))
    return text_.select("key", F.from_json("j", "c_name string, c_acctbal double").alias("v")).select("key", "v.c_name", "v.c_acctbal")


@query("SELECT o_orderkey AS key, CAST(((o_orderkey & 63) + 32) % 64 AS INTEGER) AS bucket FROM orders")
def bucket_of_key(spark, d):
    """The physical partition of a key."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), keys.bucket(F.col("o_orderkey")).alias("bucket"))


@query("""SELECT key, string_agg(k || ':' || n, ' ' ORDER BY k) FILTER (r <= 10) || CASE WHEN count(*) > 10 THEN ' ...' ELSE '' END AS preview FROM (
  SELECT l_suppkey AS key, l_partkey AS k, CAST(sum(l_linenumber) AS BIGINT) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS r FROM lineitem GROUP BY 1, 2) GROUP BY key""")
def counts_preview(spark, d):
    """X8."""
    return _order_counts(spark, d, "l_linenumber").select("key", text.preview(F.col("value")).alias("preview"))


@query("SELECT token, doc, CAST(pos AS INTEGER) AS pos FROM (SELECT doc_id AS doc, unnest(string_split(lower(text), ' ')) AS token, generate_subscripts(string_split(lower(text), ' '), 1) - 1 AS pos FROM documents)")
def inverted_index(spark, d):
    """I1 with postings of (document, offset)."""
    return index.inverted(_texts(spark, d), text.tokens(F.col("value"))).withColumnRenamed("offset", "pos")


@query("SELECT doc_id AS doc, CAST(pos AS INTEGER) AS pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS place FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS token, generate_subscripts(string_split(lower(text), ' '), 1) - 1 AS pos FROM documents) WHERE token = 'that'")
def inverted_index_read(spark, d):
    """An inverted index written in the order of tokens, and the postings of one token read from it."""
    folder = f"{_shared_folder(spark, 'inverted')}/index"
    index.write_inverted(index.inverted(_texts(spark, d), text.tokens(F.col("value"))), folder)
    found = index.gathered(spark.read.parquet(folder).filter(F.col("token") == "that"))
    return found.select(F.posexplode("postings").alias("place", "p")).select("p.doc", F.col("p.offset").alias("pos"), F.col("place").cast("long").alias("place"))


def _shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under the one that the cluster names for all executors; a temporary one in local runs without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix=f"{kind}-")
    return f"{shared}/{kind}-{uuid.uuid4().hex}"


@query(f"WITH l AS ({TOMB}) SELECT key, CAST(sum(value) AS BIGINT) AS total FROM l WHERE value IS NOT NULL AND seq > coalesce((SELECT max(seq) FROM l t WHERE t.key = l.key AND t.value IS NULL), -1) GROUP BY key")
def store_state(spark, d):
    """Half of the log written and compacted, the rest written, the state read."""
    log = event_log(spark, d, True)
    half = log.agg(F.max("seq") / 2).first()[0] or 0
    store = Catalog(spark, _shared_folder(spark, "stores")).counts("events")
    store.write(log.limit(10)).flush().drop()
    store.write(log.filter(F.col("seq") <= half)).flush().compact()
    return store.write(log.filter(F.col("seq") > half)).flush().state().withColumnRenamed("value", "total")


@query(f"SELECT {KEY64.format("'user_7_logged_in'")} AS key, count(*) AS value FROM events WHERE user_id = 7 HAVING count(*) > 0")
def store_point(spark, d):
    """Counts under string keys, compacted; one key is read from its bucket."""
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit("_logged_in"))
    store = Catalog(spark, _shared_folder(spark, "stores")).counts("logins")
    store.increase(table(spark, d, "events").select(name.alias("key"), F.col("event_id").alias("seq"))).flush().compact()
    return store.point("user_7_logged_in")


@query(f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(value) AS BIGINT) AS total FROM (WITH l AS ({TOMB}) SELECT key, sum(value) AS value FROM l WHERE value IS NOT NULL AND seq > coalesce((SELECT max(seq) FROM l t WHERE t.key = l.key AND t.value IS NULL), -1) GROUP BY key)")
def streaming_fold(spark, d):
    """The log as a stream, folded batch by batch into a maintained state."""
    from ..streaming.incremental import maintain_sums

    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    log = stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "click", F.floor("value").cast("long")).alias("value"))
    return maintain_sums(spark, log, _shared_folder(spark, "stream")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"WITH l AS ({TOMB}), s AS (SELECT key, CAST(sum(value) AS BIGINT) AS total FROM l WHERE value IS NOT NULL AND seq > coalesce((SELECT max(seq) FROM l t WHERE t.key = l.key AND t.value IS NULL), -1) GROUP BY key) SELECT * FROM s")
def store_in_memory(spark, d):
    """A store in memory, written in two halves."""
    log = event_log(spark, d, True)
    half = log.agg(F.max("seq") / 2).first()[0] or 0
    store = Catalog(spark, _shared_folder(spark, "stores")).counts("events", in_memory=True)
    store.write(log.filter(F.col("seq") <= half)).flush()
    return store.write(log.filter(F.col("seq") > half)).flush().state().withColumnRenamed("value", "total")


@query(f"WITH asked AS (SELECT key FROM ({NAMES}) UNION ALL SELECT key + 1 FROM ({NAMES})) SELECT key, count(*) AS value FROM asked JOIN (SELECT {KEY64.format('c_name')} AS key FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_custkey % 2 = 0) USING (key) GROUP BY key")
def store_bloom(spark, d):
    """A store with a filter of its keys, which rules out most of the absent keys before anything is read."""
    log = table(spark, d, "orders").filter("o_custkey % 2 = 0").join(_names(spark, d), F.col("o_custkey") == F.col("c_custkey")).select("key", F.col("o_orderkey").alias("seq"))
    store = Catalog(spark, _shared_folder(spark, "stores")).counts("orders", bloom=True)
    store.increase(log.filter("seq % 2 = 0")).flush()
    store.bloom()
    store.increase(log.filter("seq % 2 = 1")).flush()  # makes that filter out of date
    asked = _names(spark, d).select("key")
    return store.multi_get(asked.unionByName(asked.select((F.col("key") + 1).alias("key"))))


@query(f"SELECT '0-1' AS check_sum, {BLOOM.hashes} AS hashes, {BLOOM.bits}::BIGINT AS bits, bit // 64 AS word, count(DISTINCT bit) AS set_bits FROM ({_places(NAMES)}) GROUP BY ALL")
def bloom_stored(spark, d):
    """A filter written with its check sum, number of hashes and length, and read again."""
    words = sketches.with_check_sum(sketches.words_of(sketches.bits_of(_names(spark, d), BLOOM)), BLOOM, "0-1")
    folder = f"{_shared_folder(spark, 'filters')}/bloom"
    words.write.parquet(folder)
    return spark.read.parquet(folder).select("check_sum", "hashes", "bits", "word", F.bit_count("mask").cast("long").alias("set_bits"))


@query(f"SELECT doc_id AS key, length(text) + 1 AS size FROM documents WHERE list_contains(string_split(lower(text), ' '), 'that') AND doc_id % 3 <> 0 UNION ALL SELECT doc_id, 16 FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0")
def index_maintained(spark, d):
    """An index kept up by what its store tells it. Every third text is overwritten or removed after it was entered."""
    catalog = Catalog(spark, _shared_folder(spark, "stores"))
    store = catalog.create(StoreConfig("texts", "string"))
    kept = MaintainedIndex.on(catalog, store, "tokens", text.tokens)
    rows = _texts(spark, d).filter("key is not null")
    store.write(rows.select("key", F.lit(0).alias("seq"), F.concat("value", F.lit(" ")).alias("value"))).flush()
    again = F.when(F.col("key") % 2 == 0, F.lit("it is that now !"))
    store.write(rows.filter("key % 3 = 0").select("key", F.lit(1).alias("seq"), again.alias("value"))).flush()
    return kept.postings("that").select("key", F.length("value").cast("long").alias("size"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, true AS whole, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def store_salvage(spark, d):
    """What can be read of a store, with a report of its files; here all of it."""
    store = Catalog(spark, _shared_folder(spark, "stores")).counts("orders")
    store.write(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.lit(0).alias("seq"), F.lit(1).alias("value"))).flush()
    rows, report = store.salvage()
    found = rows.agg(F.count("*").alias("n"), F.sum("key").alias("keys"))
    told = report.agg(F.sum("rows").alias("rows"), (~F.max("lost")).alias("whole"))
    return found.join(F.broadcast(told)).select(F.col("rows"), (F.col("whole") & (F.col("n") == F.col("rows"))).alias("whole"), "keys")  # one row by one row


def _order_totals(spark, d, cached: bool):
    store = Catalog(spark, _shared_folder(spark, "stores")).counts("orders", cached=cached)
    return store.write(order_store(spark, d).select("key", F.lit(0).alias("seq"), "value")).flush()


@query(f"SELECT key, value FROM ({ORDERS})")
def cached_scan(spark, d):
    """What the cache of a store holds after it was read."""
    store = _order_totals(spark, d, True)
    store.state().count()
    return store.cached_rows()


@query(f"SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS place FROM ({ORDERS})")
def ordered_scan(spark, d):
    """T4: a scan in the order of keys; ids that grow along it are ranked to places."""
    folder = f"{_shared_folder(spark, 'ordered')}/rows"
    # written once: a sort that runs again may cut its rows elsewhere, and then ids and the counts of tasks don't agree
    _order_totals(spark, d, False).ordered().withColumn("at", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    before = rows.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    earlier = before.select(F.col("part").alias("p"), F.col("n").alias("m"))
    start = before.join(earlier, F.col("p") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("start"))  # a row for each task
    return rows.join(F.broadcast(start), F.shiftright("at", 33) == F.col("part")).select("key", "value", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place"))


@query("SELECT c_name AS line, CAST(sum(length(c_name) + 1) OVER () AS BIGINT) AS bytes FROM customer")
def file_lines(spark, d):
    """Lines written to files and read again, beside the bytes of those files."""
    folder = f"{_shared_folder(spark, 'files')}/lines"
    table(spark, d, "customer").select("c_name").write.text(folder)
    size = files.byte_files(spark, folder).filter("path like '%.txt'").agg(F.sum("length").alias("bytes"))
    return files.lines(spark, folder).withColumnRenamed("value", "line").join(F.broadcast(size))  # by one row


@query("SELECT c_custkey AS key, c_name, c_acctbal FROM customer WHERE c_custkey = 5")
def object_file(spark, d):
    """One object written as JSON and read again."""
    path = f"{_shared_folder(spark, 'files')}/object"
    files.store_object(table(spark, d, "customer").filter("c_custkey = 5").select(F.col("c_custkey").alias("key"), "c_name", "c_acctbal"), path)
    return files.read_object(spark, path, "key long, c_name string, c_acctbal double")


@query("SELECT count(*) AS rows, true AS in_range FROM orders")
def uniform_keys(spark, d):
    """As many random keys as there are orders, all of them below the bound."""
    keys_ = files.uniform_stream(spark, table(spark, d, "orders").count(), 1000)
    return keys_.agg(F.count("*").alias("rows"), F.coalesce(F.bool_and(F.col("key").between(0, 999)), F.lit(True)).alias("in_range"))


@query("""SELECT key, list_reduce(list_prepend(17::HUGEINT, list(v ORDER BY k)), lambda h, v: (h * 961 + v) % 2147483648)::BIGINT AS hash
  FROM (SELECT l_suppkey AS key, l_partkey AS k, (l_partkey::HUGEINT * 31 + sum(l_linenumber)) AS v FROM lineitem GROUP BY 1, 2) GROUP BY key""")
def list_hash(spark, d):
    """X3."""
    return _order_counts(spark, d, "l_linenumber").select("key", text.list_hash(F.col("value")).alias("hash"))


@query("SELECT -o_orderkey AS key, printf('%016X', -o_orderkey) AS bytes, -o_orderkey AS again FROM orders")
def long_codec(spark, d):
    """Longs as bytes, the highest first, and back."""
    rows = table(spark, d, "orders").select((-F.col("o_orderkey")).alias("key")).withColumn("data", keys.to_bytes(F.col("key")))
    return rows.select("key", F.hex("data").alias("bytes"), keys.from_bytes(F.col("data")).alias("again"))
