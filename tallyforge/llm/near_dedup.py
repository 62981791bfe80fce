"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, union-find grouping.

Plan
----
1. One Arrow pass over the texts gives each row its number of shingles, a *node* (64-bit hash of its set of
   shingles) and its band keys. Texts of equal sets share a node, so exact copies never meet each other again.
2. Band keys are grouped. In each bucket every node is held against one representative (the node with most
   copies), which is linear in the bucket, and the pairs are verified on full sets in the JVM.
3. Buckets that still hold several components, and pairs not yet held against each other, are searched exactly in
   blocks of bounded size. A task compares only pairs of different components and stops comparing nodes that it
   has joined, so a large group of near copies costs about one comparison a node.
4. Components come from local union-find on each partition and then alternating large-star and small-star steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import GOLDEN, cut, grouped, mix, pieces, ship, utf8
from .words import shingle_sets

FRACTION_BITS = 40
BLOCK = 192
#: Members of a bucket that meet in one task by the join of its key; larger buckets are salted.
SALTED = 256
#: Of so many classes of keys it is known how large their largest bucket is: a table of proven size, which is broadcast.
KEY_CLASSES = 1 << 14
#: Bytes of sets that a task of exact comparisons gets.
TASK_BYTES = 64 << 20


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, a row of ``m`` for each set (Ertl 2017).

    Each element draws its own random permutation of the m slots step by step; step j offers j + r, r in [0, 1), to the
    j-th slot of the permutation, and a slot keeps its minimum. j + r is kept as an integer of 40 fractional bits. A
    set stops once all slots hold less than its next step could offer; this loses nothing. All elements of a batch take
    a step together. A set without elements keeps the largest value everywhere.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    sign = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    if not sizes.sum():
        return sign
    flat = sign.reshape(-1)
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order: np.ndarray | None = None
    for j in range(m):
        draw = mix(element + np.uint64((int(GOLDEN) * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        offer = (np.uint64(j) << np.uint64(FRACTION_BITS)) | (draw >> np.uint64(64 - FRACTION_BITS))
        # low bits choose among the m - j slots not taken; independent of the high bits used above
        other = j + (((draw & np.uint64(0xFFFFFF)) * np.uint64(m - j)) >> np.uint64(24)).astype(np.int64)
        if order is None:
            slot = other
        else:
            rows = np.arange(len(element))
            slot = order[rows, other].astype(np.int64)
            order[rows, other] = order[rows, j]
        np.minimum.at(flat, owner * m + slot, offer)
        if j + 1 == m:
            break
        open_ = sign.max(axis=1) >= np.uint64((j + 1) << FRACTION_BITS)
        keep = open_[owner]
        if not keep.any():
            break
        if order is None:
            other = other[keep]
            order = np.tile(np.arange(m, dtype=np.uint16), (len(other), 1))
            order[np.arange(len(other)), other] = 0
        else:
            order = order[keep]
        element, owner = element[keep], owner[keep]
    return sign


def band_keys(sign: np.ndarray, bands: int) -> np.ndarray:
    rows = sign.shape[1] // bands
    keys = np.zeros((len(sign), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys + sign[:, r : rows * bands : rows] + GOLDEN)
    return mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN)


def node_of(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix(own: np.ndarray, percent: int) -> np.ndarray:
    """So many of a set's smallest hashes that any set similar enough has one of them among its own."""
    return own[: len(own) - -(-percent * len(own) // 100) + 1]


def _sketches(k: int, m: int, bands: int, percent: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            more = [c for c in batch.schema.names if c not in ("id", "text")]
            for a, b in pieces(offsets):
                sets = shingle_sets(data, offsets[a : b + 1], k)
                keys = [prefix(s, percent).view(np.int64) for s in sets] if exact else list(band_keys(super_minhash(sets, m), bands).view(np.int64))
                keys = [x[: len(x) * (len(s) > 0)] for x, s in zip(keys, sets)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(at, np.concatenate([*keys, np.zeros(0, np.int64)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), lists, *[batch.column(c).slice(a, b - a) for c in more]],
                    ["id", "n_shingles", "node", "keys", *more],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            wanted = batch.column("node").to_numpy(zero_copy_only=False)
            for a, b in pieces(offsets):
                sets = shingle_sets(data, offsets[a : b + 1], k)
                own = [(int(w), s) for w, s in zip(wanted[a:b], sets) if len(s) and node_of(s) == w]
                if own:
                    at = np.concatenate([[0], np.cumsum([len(s) for _, s in own])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.int64()), pa.ListArray.from_arrays(at, np.concatenate([s for _, s in own]).view(np.int64))], ["node", "set"])

    return run


def similar(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


class Forest:
    """Union-find with the smallest member as root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _block_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "task"):
            if (found := block_links(group, percent)):
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return run


def block_links(group: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Verified links between nodes of different components in a block, or between two blocks of a bucket."""
    node, rep, comp, block = (group.column(c).to_pylist() for c in ("node", "rep", "comp", "block"))
    lists = group.column("set").combine_chunks()
    at, values = np.asarray(lists.offsets), np.asarray(lists.values)
    sets = [values[at[i] : at[i + 1]] for i in range(len(node))]
    two = len(set(block)) > 1
    forest, found = Forest(), []
    order = sorted(range(len(node)), key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if percent * len(sets[j]) > 100 * len(sets[i]):
                break
            if node[i] == rep[i] or node[j] == rep[j] or two and block[i] == block[j] or forest.root(comp[i]) == forest.root(comp[j]):
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if similar(shared, len(sets[i]), len(sets[j]), percent):
                forest.join(comp[i], comp[j])
                found.append((node[i], node[j]))
    return found


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's links; a star around each root replaces them. Cleared when it grows large."""
    forest = Forest()

    def out() -> pa.RecordBatch:
        members = [(x, forest.root(x)) for x in list(forest.up)]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in members], pa.int64()), pa.array([b for _, b in members], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            if a != b:
                forest.join(a, b)
        if len(forest.up) > 500_000:
            yield out()
            forest = Forest()
    yield out()


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the ends of links (a, b): comp is the smallest node reachable. Roots are left out."""
    edges = cut(links.select("a", "b").mapInArrow(_local_forest, "a long, b long").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b")).filter("a <> b")
        edges = cut(small.distinct())


def _salted(df: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds salts, the number of salts of each row's key."""
    out = df.withColumn("class", F.pmod("key", F.lit(KEY_CLASSES))).join(F.broadcast(hot), "class", "left")  # KEY_CLASSES rows at most
    return out.withColumn("salts", F.coalesce("salts", F.lit(1))).drop("class")


def _bucket_rows(nodes: DataFrame) -> DataFrame:
    """(key, node, n, size, rep, rep_n, salts, salt) of the buckets of two nodes or more.

    Sizes and representatives are aggregated before the shuffle. To be joined back, the members of a large bucket are dealt
    to several salts, and the bucket's one row is repeated for each.
    """
    members = nodes.select("node", "copies", "n", F.explode("keys").alias("key"))
    heads = cut(members.groupBy("key").agg(F.count("*").alias("size"), F.max(F.struct("copies", "node", "n")).alias("rep")).filter("size > 1"))
    hot = heads.filter(F.col("size") > SALTED).groupBy(F.pmod("key", F.lit(KEY_CLASSES)).alias("class")).agg(F.ceil(F.max("size") / SALTED).cast("int").alias("salts"))
    heads = _salted(heads, hot).select("key", "size", "rep", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    members = _salted(members.select("key", "node", "n"), hot).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    return members.join(heads, ["key", "salt"]).select("key", "node", "n", "size", F.col("rep.node").alias("rep"), F.col("rep.n").alias("rep_n"), "salts", "salt")


def _blocks(open_: DataFrame) -> DataFrame:
    """(node, rep, comp, block, task): the pairs of blocks, as tasks, in which the nodes (key, node, rep, comp, salts, salt) of open buckets meet.

    Only nodes of different components need to meet. A component of BLOCK nodes or more has blocks of its own, which don't meet each other; smaller
    ones share blocks. So a bucket of one large component and a few other nodes sends each node of the former to few tasks.
    """
    of = open_.groupBy("key", "comp").agg(F.count("*").alias("c"), F.max("salts").alias("salts"))
    large = of.filter(F.col("c") >= BLOCK).withColumn("own", F.ceil(F.col("c") / BLOCK).cast("long"))
    before = F.sum("own").over(Window.partitionBy("key").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1))  # a row for BLOCK nodes
    large = large.withColumn("low", F.coalesce(before, F.lit(0)))
    small = of.filter(F.col("c") < BLOCK).groupBy("key").agg(F.ceil(F.sum("c") / BLOCK).cast("long").alias("shared"), F.max("salts").alias("salts"))
    taken = large.groupBy("key").agg(F.sum("own").alias("taken"), F.max("salts").alias("more"))
    layout = small.join(taken, "key", "full_outer").select("key", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("salts", "more").alias("salts"))
    layout = layout.select("key", "shared", "taken", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    large = large.select("key", "comp", "own", "low", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = open_.join(layout, ["key", "salt"]).join(large, ["key", "comp", "salt"], "left")
    mixed = F.col("taken") + F.pmod(F.xxhash64("comp", "node"), F.greatest("shared", F.lit(1)))
    block = F.when(F.col("own").isNull(), mixed).otherwise(F.col("low") + F.pmod(F.xxhash64("node"), F.col("own")))
    every = F.sequence(F.lit(0).cast("long"), F.col("taken") + F.col("shared") - 1)
    apart = F.when(F.col("own").isNull(), every).otherwise(F.filter(every, lambda b: (b < F.col("low")) | (b >= F.col("low") + F.col("own"))))
    rows = rows.withColumn("block", block).select("key", "node", "n", "rep", "comp", "block", F.explode(apart).alias("other"))
    return rows.select("node", "n", "rep", "comp", "block", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("task"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, percent: int = 85, bands: int = 16, rows: int = 4, exact: bool = False, mark: F.Column | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. Two rows are linked when
    100 * shared >= percent * united of their sets of ``shingle_words``-word shingles; component_id is the smallest
    id reachable over links, and kept tells that a row's id is it. A pair of just that similarity s is missed by the
    bands with probability (1 - s**rows)**bands: 8e-6 by default. ``exact`` takes, in place of bands, the smallest hashes of each
    set as its keys, so many that no link can be missed; it costs more where a shingle is common.

    Null and empty texts have an empty set and stand alone. A null id takes part in no minimum: such a row gets the
    smallest id of its group, or null, and kept is then false, or true if it stands alone. Repeated rows and ids are kept; each row goes by
    its own text. Further columns are ignored. With ``mark``, a string column that tells rows apart, the result has it too,
    and ``group``: one number for all rows linked, whatever their ids, null for an empty set.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = source if mark is None else docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), mark.alias("mark"))
    schema = "id long, n_shingles long, node long, keys array<long>" + (", mark string" if mark is not None else "")
    base = cut(marked.mapInArrow(_sketches(shingle_words, bands * rows, bands, percent, exact), schema))
    nodes = cut(base.filter("node is not null").groupBy("node").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")))

    buckets = cut(_bucket_rows(nodes))

    close = f"100 * least(n, rep_n) >= {percent} * greatest(n, rep_n)"
    star = buckets.filter(f"node <> rep and {close}").select("node", "rep").distinct()
    wide = buckets.filter("size > 2").select("node")
    wanted = star.select("node").union(star.select(F.col("rep").alias("node"))).union(wide).distinct()
    wanted = wanted.join(nodes.select("node", "least_id"), "node").select("node", F.col("least_id").alias("id"))
    # an id that is null still finds its text
    texts = source.join(wanted, source["id"].eqNullSafe(wanted["id"])).select("node", "text")
    sets = cut(texts.mapInArrow(_sets(shingle_words), "node long, set array<long>").groupBy("node").agg(F.first("set").alias("set")))

    right = sets.select(F.col("node").alias("rep"), F.col("set").alias("rep_set"))
    shared = F.size(F.array_intersect("set", "rep_set"))
    links = star.join(sets, "node").join(right, "rep").withColumn("shared", shared)
    links = links.filter(f"100 * shared >= {percent} * (size(set) + size(rep_set) - shared)").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    groups = cut(components(links))

    open_ = buckets.filter("size > 2").join(groups, "node", "left").select("key", "node", "n", "rep", "salts", "salt", F.coalesce("comp", "node").alias("comp"))
    split = open_.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("salts").alias("more")).filter("low <> high").select("key", F.explode(F.sequence(F.lit(0), F.col("more") - 1)).alias("salt"))
    tasks = cut(_blocks(open_.join(split, ["key", "salt"])))
    volume = tasks.agg(F.sum("n")).first()[0] or 0
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-8 * volume // TASK_BYTES))
    met = tasks.drop("n").join(sets, "node")
    more = met.repartition(width, "task").sortWithinPartitions("task").mapInArrow(_block_links(percent), "a long, b long")
    more = cut(more.distinct())
    if more.head(1):
        groups = components(more.unionByName(groups.select(F.col("node").alias("a"), F.col("comp").alias("b"))))

    home = nodes.select("node", "least_id").join(groups, "node", "left").select("node", "least_id", F.coalesce("comp", "node").alias("comp"))
    least = home.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    home = home.join(least, "comp").select("node", "component_id", F.col("comp").alias("group"))
    further = [] if mark is None else ["mark"]
    out = base.select("id", "n_shingles", "node", *further).join(home, "node", "left")
    further += [] if mark is None else ["group"]
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.when(own.isNull(), True).otherwise(F.coalesce(F.col("id") == own, F.lit(False))).alias("kept"), *further)
