"""WARC: Merkle fixity audit.

A record is the bytes of one WARC/1.1 resource. A replica is placed on its own: a file holds 256 ids from a multiple of it, its records in
the order of ids lie at offsets that add up their lengths, so one lost record moves all that follow it in the file. The
tree therefore goes by ids: the contents of an id, ranges of sixteen adjacent ids, files of sixteen ranges, and sixteen
nodes under each one above, up to one root. A node hashes its children's places and hashes in order. Two replicas are
compared from the root down, and only below nodes that differ, to the records that are damaged, missing or added. The
audit is SQL functions alone. No group of it holds more than sixteen hashes, but for the different contents of one id,
which are hashed by the first digits of their digests first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, ship

FAN_BITS = 4
#: A file holds 2**FILE_BITS ids.
FILE_BITS = 8
#: A file of more different records, which takes repeated ids or ones without an id, is written in parts.
PART_RECORDS = 4096
DATE = "1970-01-01T00:00:00Z"


def header(record_id, url, length) -> F.Column:
    """The head of a resource record. Its WARC-Record-ID is made of an md5 of the id and the url."""
    name = F.md5(F.concat_ws("|", F.coalesce(record_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    lines = [F.lit("WARC/1.1"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))), F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), length.cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(record_id, record): each page as the bytes of a WARC record. Null urls and pages count as empty."""
    content = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    record = F.concat(F.encode(header(F.col(id_col).cast("long"), F.col(url_col), F.octet_length(content)), "UTF-8"), content, F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    return pages.select(F.col(id_col).cast("long").alias("record_id"), record.alias("record"))


class WarcError(ValueError):
    """Bytes that are not a sequence of WARC records."""


def split_warc(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each record of an uncompressed WARC file, its closing line ends included."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        m = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", data[at : head + 2], re.I) if head >= 0 and data[at : at + 5] == b"WARC/" else None
        end = head + 8 + int(m[1]) if m else 0
        if not m or data[end - 4 : end] != b"\r\n\r\n":
            raise WarcError(f"no record at byte {at}")
        yield at, data[at:end]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, record_offset, record, error) of the WARC files under a path of any file system that Spark reads.

    A file that breaks off gives its whole records and one row with an error and no record. A file is read by one
    task, as its records can't be found from its middle.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("record_offset", pa.int64()), ("record", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                at = 0
                try:
                    for at, record in split_warc(data.as_py()):
                        yield pa.RecordBatch.from_pylist([{"path": name, "record_offset": at, "record": record}], schema)
                except WarcError as e:
                    yield pa.RecordBatch.from_pylist([{"path": name, "record_offset": at, "error": str(e)}], schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, "path string, record_offset long, record binary, error string")


def manifest(stored: DataFrame) -> DataFrame:
    """(file, part, record_id, record_offset, length, copies, digest) of one replica's (record_id, record).

    Equal records of an id are one row with its number of copies, which lie one after the other from record_offset. A
    file holds 256 ids from a multiple of it; records without an id are in a file of their own, whose number is null. Records lie in the order of
    ids, then digests. A file of more than PART_RECORDS rows is written in parts, dealt by digest, so that no id fills
    a task. Bytes are hashed where they lie: what is dealt out to be placed is a digest.
    """
    rows = stored.select(F.col("record_id").cast("long").alias("record_id"), F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("length"))
    # read twice below; kept, so that records are read and hashed once
    rows = cut(rows.groupBy("record_id", "digest", "length").agg(F.count("*").alias("copies"))).withColumn("file", F.shiftright("record_id", FILE_BITS))
    large = rows.groupBy(F.col("file").alias("__file")).agg(F.count("*").alias("__n")).filter(F.col("__n") > PART_RECORDS)
    rows = rows.join(large, F.col("file").eqNullSafe(F.col("__file")), "left")
    part = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.ceil(F.coalesce("__n", F.lit(1)) / PART_RECORDS))
    rows = rows.withColumn("part", part.cast("int"))
    order = Window.partitionBy("file", "part").orderBy(F.asc_nulls_first("record_id"), "digest").rowsBetween(Window.unboundedPreceding, 0)
    taken = F.col("length") * F.col("copies")
    return rows.withColumn("record_offset", F.sum(taken).over(order) - taken).select(*LEAF)


LEAF = ["file", "part", "record_id", "record_offset", "length", "copies", "digest"]


def _hashed(level: DataFrame, by: list, place, own) -> DataFrame:
    """The nodes ``by`` over ``level``: each hashes its children's places and hashes in order."""
    children = F.array_sort(F.collect_list(F.struct(place.alias("p"), own.alias("h"))))
    line = F.array_join(F.transform(children, lambda x: F.concat(x["p"].cast("string"), F.lit(":"), x["h"])), "\n")
    return level.groupBy(*by).agg(F.sha2(line.cast("binary"), 256).alias("digest"))


def _ids(placed: DataFrame) -> DataFrame:
    """(side, node, slot, digest): the contents of each id. Those of one prefix are hashed first, as an id may have any number."""
    some = _hashed(placed, ["side", "node", "slot", F.substring("digest", 1, 3).alias("prefix")], F.col("digest"), F.col("copies").cast("string"))
    return _hashed(some, ["side", "node", "slot"], F.col("prefix"), F.col("digest"))


def _ranges(ids: DataFrame) -> DataFrame:
    return _hashed(ids, ["side", "node", F.shiftright("slot", FAN_BITS).alias("range")], F.col("slot"), F.col("digest"))


def _above(level: DataFrame) -> DataFrame:
    return _hashed(level, ["side", F.shiftright("node", FAN_BITS).alias("node")], F.col("node") % (1 << FAN_BITS), F.col("digest"))


def differing(level: DataFrame, *keys: str) -> DataFrame:
    """The nodes whose digests differ or that one side lacks."""
    return level.groupBy(*keys).agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).filter("n < 2 or low <> high").select(*keys)


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(record_id, digest, length, status, copies, their_copies, descended, file, part, record_offset, their_part, their_offset)
    from the manifests of two replicas: a row for each different record of each id of either.

    status is ``ok``; ``missing`` if the second replica has fewer copies and no other record under the id; ``damaged`` if it has
    fewer and another record instead, which is a row of its own, ``altered``; ``added`` if it has more copies and
    lacks nothing of the id. Records without an id count as those of one id. descended tells whether the walk came down to the record's
    range of sixteen ids. their_part and their_offset are given for the ids that differ: all others were only compared by
    hashes, and may lie elsewhere in a file that lost or gained a record. Two empty tables give an empty one.
    """
    sides = [x.select(*LEAF).withColumn("side", F.lit(s)) for s, x in enumerate((ours, theirs))]
    both = cut(sides[0].unionByName(sides[1]))
    first, last = both.agg(F.min("file"), F.max("file")).first()
    first, last = (0, -1) if first is None else (first, last)
    both = both.withColumn("node", F.coalesce(F.col("file") - first, F.lit(last - first + 1))).withColumn("slot", F.coalesce(F.col("record_id").bitwiseAND(F.lit((1 << FILE_BITS) - 1).cast("long")), F.lit(0)).cast("int"))
    ids = _ids(both)
    levels = [cut(_hashed(_ranges(ids), ["side", "node"], F.col("range"), F.col("digest")))]  # a root for each file
    while (last - first + 1) >> FAN_BITS * (len(levels) - 1):
        levels.append(cut(_above(levels[-1])))
    bad = cut(differing(levels.pop(), "node"))
    while levels:
        up = bad.withColumnRenamed("node", "up")
        below = levels.pop().withColumn("up", F.shiftright("node", FAN_BITS)).join(up, "up", "left_semi")
        bad = cut(differing(below, "node"))
    near = both.join(bad, "node", "left_semi")  # what lies in the files that differ
    seen = cut(differing(_ranges(_ids(near)), "node", "range"))
    near = both.withColumn("range", F.shiftright("slot", FAN_BITS)).join(seen, ["node", "range"], "left_semi")
    wrong = cut(differing(_ids(near), "node", "slot"))

    def of(side: int, name: str) -> F.Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))

    pair = both.join(wrong, ["node", "slot"], "left_semi").groupBy("node", "slot", "file", "record_id", "digest", "length").agg(F.coalesce(of(0, "copies"), F.lit(0)).alias("copies"), F.coalesce(of(1, "copies"), F.lit(0)).alias("their_copies"), of(0, "part").alias("part"), of(0, "record_offset").alias("record_offset"), of(1, "part").alias("their_part"), of(1, "record_offset").alias("their_offset"))
    pair = cut(pair.withColumn("short", F.col("copies") > F.col("their_copies")).withColumn("more", F.col("copies") < F.col("their_copies")))
    of_id = pair.groupBy("node", "slot").agg(F.max("short").alias("any_short"), F.max("more").alias("any_more"))
    status = F.when(F.col("short"), F.when(F.col("any_more"), "damaged").otherwise("missing")).when(F.col("more"), F.when(F.col("any_short"), "altered").otherwise("added")).otherwise("ok")
    found = pair.join(of_id, ["node", "slot"]).withColumn("status", status).withColumn("descended", F.lit(True))
    rest = both.filter("side = 0").join(wrong, ["node", "slot"], "left_anti").withColumn("range", F.shiftright("slot", FAN_BITS)).join(seen.withColumn("descended", F.lit(True)), ["node", "range"], "left")
    rest = rest.withColumn("descended", F.coalesce("descended", F.lit(False))).withColumn("status", F.lit("ok")).withColumn("their_copies", F.col("copies")).withColumn("their_part", F.lit(None).cast("int")).withColumn("their_offset", F.lit(None).cast("long"))
    shown = ["record_id", "digest", "length", "status", "copies", "their_copies", "descended", "file", "part", "record_offset", "their_part", "their_offset"]
    return rest.select(*shown).unionByName(found.select(*shown))


def drill(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two replicas (record_id, record) that differ as planted: by the first two hexadecimal digits of an md5 of the id,
    two of 256 records have their last byte changed in the second, two are lost there, two are lost in the first, and two stand twice in the second."""
    sign = F.substring(F.md5(F.coalesce(F.col("record_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    hurt = F.concat(F.expr("substring(record, 1, octet_length(record) - 1)"), F.encode(F.lit("?"), "UTF-8"))
    ours = stored.filter(~sign.isin("04", "05")).select("record_id", "record")
    theirs = stored.filter(~sign.isin("02", "03")).withColumn("times", F.when(sign.isin("06", "07"), 2).otherwise(1))
    theirs = theirs.select("record_id", F.when(sign.isin("00", "01"), hurt).otherwise(F.col("record")).alias("record"), "times")
    return ours, theirs.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select("record_id", "record")
