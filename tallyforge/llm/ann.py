"""Approximate nearest neighbours by learned partitions.

On a bounded sample the driver builds the graph of nearest neighbours, cuts it into parts of equal size with few broken
edges, and trains a small network to tell, for a vector, in which parts its neighbours lie. Every row is indexed
under the network's first choice; a query is routed to its most probable parts, until their probabilities add up to the mass that
a bounded sample of rows needs for the wanted recall of its true neighbours among all rows: a query amid one part searches few, one between parts more. All rows there are ranked by exact distance.

Where a table needs more parts than one machine can learn, each part is cut in the same way into parts of its own. Executors
learn these, from a bounded sample of the part's rows and of rows of other parts that would search it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, grouped, ship

POINTS, QUERIES = 4096, 512
#: Bytes of vectors that a task of the search gets.
TASK_BYTES = 64 << 20
NEIGHBOURS = 10
#: Parts by default, at least, and at most for one router; the rows of the sample for each.
FEWEST_PARTS, MOST_PARTS, SAMPLE_OF_PART = 32, 256, 256
#: Rows of a part that are routed by one task within it.
ROUTED = 65_536
#: Rows, about, whose true neighbours among all rows set the mass.
CALIBRATION_ROWS = 256


def parts_for(total: int) -> int:
    """The largest power of two up to sqrt(total) / 32, but 32 at least and what two levels of routers can tell at most (enough for
    4e12 rows): the finer the parts, the less is searched, but each needs its share of a sample."""
    parts = FEWEST_PARTS
    while parts < MOST_PARTS**2 and (2 * parts * 32) ** 2 <= total:
        parts *= 2
    return parts


def neighbour_graph(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """The k nearest others in ``x`` of each of its vectors, or the k nearest of each vector ``of``, in blocks."""
    own, of = of is None, x if of is None else of
    n, out = len(of), np.zeros((len(of), k), np.int64)
    square = (x * x).sum(axis=1)
    step = max(1, min(512, (1 << 22) // max(len(x), 1)))  # 32 MB a block
    for a in range(0, n, step):
        d = square[None, :] - 2 * of[a : a + step] @ x.T
        if own:
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + step] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _bisect(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for half of the nodes, such that few of the edges (a, b) between positions in ``nodes`` are cut: the order
    along the second eigenvector of the random walk, then swaps of pairs that lower the cut."""
    n = len(nodes)
    degree = np.maximum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), 1).astype(float)
    weight = np.sqrt(degree)
    weight /= np.linalg.norm(weight)
    v = rng.standard_normal(n)
    for _ in range(60):
        v -= weight * (weight @ v)
        y = v / np.sqrt(degree)
        v = v + (np.bincount(a, y[b], n) + np.bincount(b, y[a], n)) / np.sqrt(degree)  # lazy walk: no sign flips
        v /= np.linalg.norm(v) or 1
    side = np.zeros(n, bool)
    side[np.argsort(v / np.sqrt(degree), kind="stable")[n // 2 :]] = True
    for _ in range(8):
        s = np.where(side, 1.0, -1.0)
        gain = -(np.bincount(a, s[b], n) + np.bincount(b, s[a], n)) * s
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left])], right[np.argsort(-gain[right])]
        m = min(len(left), len(right))
        good = int((gain[left[:m]] + gain[right[:m]] > 0).sum()) // 2
        if not good:
            break
        before = int((side[a] != side[b]).sum())
        trial = side.copy()
        trial[left[:good]], trial[right[:good]] = True, False
        if int((trial[a] != trial[b]).sum()) >= before:
            break
        side = trial
    return side


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each node of a graph of neighbours, by recursive bisection; sizes differ by the number of levels at most."""
    n = len(near)
    part = np.zeros(n, np.int64)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.reshape(-1)
    for _ in range(int(np.log2(parts))):
        split = np.zeros(n, np.int64)
        for p in np.unique(part):
            nodes = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (place[a] >= 0) & (place[b] >= 0)
            split[nodes] = _bisect(nodes, place[a[inside]], place[b[inside]], rng)
        part = 2 * part + split
    return part


@dataclass
class Router:
    """A network with one hidden layer; its outputs are the logits of the parts."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 40) -> Router:
        """``target`` holds, for each vector, the share of its neighbours in each part."""
        mean, scale = x.mean(axis=0), x.std() or 1.0
        x = (x - mean) / scale
        sizes = [x.shape[1], hidden, target.shape[1]]
        w = [v for a, b in zip(sizes, sizes[1:]) for v in (rng.standard_normal((a, b)) * np.sqrt(2 / a), np.zeros(b))]
        first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
        step, batch = 0, 128
        for epoch in range(epochs):
            rate = 2e-3 * (1 - epoch / epochs) + 1e-4
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                h = np.maximum(x[rows] @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                d = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
                back = (d @ w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    w[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        return cls(mean, scale, w)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum((x - self.mean) / self.scale @ w[0] + w[1], 0) @ w[2] + w[3]


@dataclass
class Index:
    router: Router
    parts: int
    mass: float

    def ranked(self, x: np.ndarray, mass: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The parts of each vector, the most probable first, and how many of them its mass takes."""
        logits = self.router.logits(x)
        order = np.argsort(-logits, axis=1, kind="stable")
        return order, (_before(logits, order) <= (self.mass if mass is None else mass)).sum(axis=1)

    def before(self, x: np.ndarray) -> np.ndarray:
        """For each vector and part the probability of all parts that come before it."""
        logits = self.router.logits(x)
        order = np.argsort(-logits, axis=1, kind="stable")
        return np.take_along_axis(_before(logits, order), np.argsort(order, axis=1), axis=1)


def _quantile(needed: np.ndarray, recall: float) -> float:
    """The least mass that suffices for the share ``recall`` of what needs these masses."""
    needed = np.sort(needed.reshape(-1))
    return float(needed[min(len(needed) - 1, max(0, int(np.ceil(recall * len(needed))) - 1))])


def _before(logits: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The probability of all parts before each place of ``order``."""
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p = np.take_along_axis(p / p.sum(axis=1, keepdims=True), order, axis=1)
    return np.cumsum(p, axis=1) - p


def fit(x: np.ndarray, parts: int, recall: float, seed: int = 0, visitors: np.ndarray | None = None) -> Index:
    """Learn from the sample ``x``, and from ``visitors``, vectors that only search. The mass is the least that finds
    ``recall`` of the neighbours in the sample of the fifth of both that the router hasn't learned from."""
    rng = np.random.default_rng(seed)
    k = min(NEIGHBOURS, max(len(x) - 1, 1))
    if parts < 2 or len(x) < 4 * parts:
        return Index(Router(np.zeros(x.shape[1]), 1.0, [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)]), 1, 1.0)
    near, own = neighbour_graph(x, k), len(x)
    part = balanced_parts(near, parts, rng)
    if visitors is not None and len(visitors):
        near = np.concatenate([near, neighbour_graph(x, k, visitors)])
        x = np.concatenate([x, visitors])
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), k), part[near].reshape(-1)), 1.0)
    target[np.arange(own), part] += 2
    target /= target.sum(axis=1, keepdims=True)
    test = rng.permutation(len(x))[: max(1, len(x) // 5)]
    learn = np.ones(len(x), bool)
    learn[test] = False
    router = Router.fit(x[learn], target[learn], rng)
    index, home = Index(router, parts, 1.0), router.logits(x[:own]).argmax(axis=1)
    index.mass = _quantile(np.take_along_axis(index.before(x[test]), home[near[test]], axis=1), recall)
    return index


def _placed(index: Index | None, x: np.ndarray, counts: dict[int, int], ids: dict[int, int], k: int, base: int = 0, mass: float | None = None) -> list[list[int]]:
    """The part of each row; of queries the parts to search, as many more as hold k ids besides the query's. ``counts``
    has the rows of each part, ``ids`` the ids, each counted in one of its parts only; it is empty for rows. Parts are numbered from ``base``."""
    if index is None:  # a part of so few rows that none came into the sample
        return [[base] if not counts or counts.get(base) else []] * len(x)
    ranked, wanted = index.ranked(x, mass)
    if not counts:
        return [[base + int(p)] for p in ranked[:, 0]]
    found = []
    for order, probes in zip(ranked, wanted):
        take, rows = 0, 0
        while take < index.parts and (take < probes or rows < k + 1):
            rows += ids.get(base + int(order[take]), 0)
            take += 1
        found.append([base + int(p) for p in order[:take] if counts.get(base + int(p))])
    return found


def _assign(shared, counts: dict[int, int], ids: dict[int, int], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _placed(shared.value, vectors(batch.column("v")), counts, ids, k)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(found, pa.list_(pa.int32()))], ["id", "v", "parts"])

    return run


def _learn(children: dict[int, int], recall: float):
    """(part, model) for each part, from its sampled rows and visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "part"):
            part = group.column("part")[0].as_py()
            x, visits = vectors(group.column("v")), group.column("visits").to_numpy(zero_copy_only=False).astype(bool)
            order = np.lexsort((*x.T, group.column("id").to_numpy()))  # whatever order the rows came in
            x, visits = x[order], visits[order]
            model = pickle.dumps(fit(x[~visits], children[part], recall, part, x[visits]))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([model], pa.binary())], ["part", "model"])

    return run


def _descend(counts: dict[int, int], ids: dict[int, int], k: int, mass: float | None):
    """The same as _assign within parts: the row with the model comes first in its task. Without ``k``, what a vector's mass must be to
    reach each part within (see Index.before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, index = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tasks = batch.column("task").to_numpy()
            cuts = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1), len(tasks)]
            for a, b in zip(cuts, cuts[1:]):
                if tasks[a] != task:
                    task, index = tasks[a], None
                rows = batch.slice(a, b - a)
                model = rows.column("model")[0].as_py()
                if model is not None:
                    index, rows = pickle.loads(model), rows.slice(1)
                if rows.num_rows:
                    part, x = rows.column("part")[0].as_py(), vectors(rows.column("v"))
                    if k:
                        found = pa.array(_placed(index, x, counts, ids, k, part * MOST_PARTS, mass), pa.list_(pa.int32()))
                    else:
                        found = pa.array((index.before(x) if index else np.zeros((len(x), 1))).tolist(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("v"), rows.column("part"), found], ["id", "v", "part", "found"])

    return run


def _within(rows: DataFrame, sizes: dict[int, int], models: DataFrame, counts: dict[int, int], ids: dict[int, int], k: int, mass: float | None = None) -> DataFrame:
    """(id, v, part, found): rows (id, v, part) placed within their parts by _descend. A part's rows are dealt over tasks of some ROUTED rows,
    and its model goes to each of them. ``sizes`` has the rows of each part, of MOST_PARTS at most."""
    spark = rows.sparkSession
    deal = F.broadcast(spark.createDataFrame([(p, -(-n // ROUTED)) for p, n in sizes.items()], "part int, tasks long"))
    task = F.xxhash64("part", "mine")
    own = rows.join(deal, "part").withColumn("mine", F.pmod(F.xxhash64("id", "v"), "tasks"))
    led = models.join(deal, "part").withColumn("mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)))
    own = own.select(task.alias("task"), F.lit(1).alias("place"), "part", "id", "v", F.lit(None).cast("binary").alias("model"))
    led = led.select(task.alias("task"), F.lit(0).alias("place"), "part", F.lit(0).cast("long").alias("id"), F.array().cast("array<double>").alias("v"), "model")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(-(-n // ROUTED) for n in sizes.values()))
    met = own.unionByName(led).repartition(width, "task").sortWithinPartitions("task", "place")
    return met.mapInArrow(_descend(counts, ids, k, mass), f"id long, v array<double>, part int, found array<{'int' if k else 'double'}>")


def _truth(points: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """(place in x, part) of the k rows nearest to each of these few vectors, among all rows but those of its own id."""
    square = (x * x).sum(axis=1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, part = np.full((len(x), k), np.inf), np.zeros((len(x), k), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, POINTS):
                some = batch.slice(at, POINTS)
                y = vectors(some.column("v"))
                d = square + (y * y).sum(axis=1) - 2 * x @ y.T
                d[ids[:, None] == some.column("id").to_numpy()] = np.inf
                d = np.concatenate([best, d], axis=1)
                parts = np.concatenate([part, np.broadcast_to(some.column("part").to_numpy(), (len(x), len(y)))], axis=1)
                pick = np.argpartition(d, k - 1, axis=1)[:, :k]
                best, part = np.take_along_axis(d, pick, axis=1), np.take_along_axis(parts, pick, axis=1)
        place, at = np.nonzero(best < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(part[place, at], pa.int64()), pa.array(best[place, at])], ["place", "part", "d"])

    near = points.mapInArrow(run, "place long, part long, d double")
    rank = F.row_number().over(Window.partitionBy("place").orderBy("d", "part"))
    got = near.withColumn("rank", rank).filter(F.col("rank") <= k).select("place", "part").toArrow()  # len(x) times k at most
    return np.stack([got.column("place").to_numpy(), got.column("part").to_numpy()], axis=1)


def _counts(points: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """The rows of each part, and its ids, each in its first part only."""
    ids = points.groupBy("id").agg(F.min("part").alias("part"))
    return {r[0]: r[1] for r in points.groupBy("part").count().collect()}, {r[0]: r[1] for r in ids.groupBy("part").count().collect()}


def vectors(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "task"):
            rows = nearest(group, k)
            if rows:
                q, v, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(group: pa.Table, k: int) -> list[tuple[int, int, float]]:
    """The k nearest ids of a block for each query of a block, each at its nearest row."""
    ids, query, x = group.column("id").to_numpy(), group.column("query").to_numpy(zero_copy_only=False).astype(bool), vectors(group.column("v"))
    points, names, out = x[~query], ids[~query], []
    if not len(points):
        return []
    order = np.argsort(names, kind="stable")
    points, names = points[order], names[order]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    own = names[first]
    for q, v in zip(ids[query], x[query]):
        d = np.sqrt(np.square(points - v).sum(axis=1))
        d[names == q] = np.inf
        d = np.minimum.reduceat(d, first)
        pick = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
        pick = pick[np.lexsort((own[pick], d[pick]))][:k]
        out += [(int(q), int(own[i]), float(d[i])) for i in pick if d[i] != np.inf]
    return out


def search(
    table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, query_modulus: int = 100, sample_rows: int | None = None,
    recall: float = 0.96, rows_per_part: int = 60, most_parts: int | None = None, router_parts: int = MOST_PARTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``query_modulus``.

    score is the Euclidean distance in doubles; ties go to the smaller id. Rows with a null id, and vectors that are null, zero,
    hold null or non-finite components or aren't of the commonest length, take no part. A query's own id is never a
    candidate, even if other rows repeat it; repeated rows of another id count once, and an id of several vectors stands
    at its nearest. Equal rows are made one before all else. The index is fitted on about ``sample_rows`` rows chosen by a hash of id and vector, which bounds what the driver gets; all rows are indexed. By default
    there are 32 parts, more for tables of millions of rows (see parts_for), and 256 rows of the sample for each. Beyond
    ``router_parts`` parts (at most 256) they are cut in two levels, the second by executors, the larger parts into more, with the root of
    ``recall`` for each level. What a query searches is set by the true neighbours of CALIBRATION_ROWS rows. Rows of a part and its queries meet in blocks of about 4096 by 512, however many there are.
    """
    ship(table.sparkSession)
    spark = table.sparkSession
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = cut(rows.filter(fine).distinct())
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head(1)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dims, total = sizes[0]
    most_parts = most_parts or parts_for(total)
    parts = 1
    while parts < most_parts and parts * rows_per_part < total:
        parts *= 2
    top = min(parts, router_parts, MOST_PARTS)
    level_recall = recall if top == parts else recall**0.5
    sample_rows = sample_rows or SAMPLE_OF_PART * min(most_parts, router_parts, MOST_PARTS)
    rows = rows.filter(F.size("v") == dims)
    share = int(min(1.0, sample_rows / total) * 1_000_000_000) + 1
    drawn = F.pmod(F.xxhash64("id", "v"), F.lit(1_000_000_000))
    sample = rows.filter(drawn < share).select("id", "v").toArrow()
    x = vectors(sample.column("v"))[np.argsort(sample.column("id").to_numpy(), kind="stable")]
    index = fit(x, top, level_recall) if len(x) else fit(np.zeros((1, dims)), 1, recall)
    shared = spark.sparkContext.broadcast(index)

    schema = "id long, v array<double>, parts array<int>"
    each, first = F.explode("parts").alias("part"), F.element_at("parts", 1).alias("part")
    points = cut(rows.mapInArrow(_assign(shared, {}, {}, k), schema).select("id", "v", first))
    top_counts, top_ids = counts, ids = _counts(points)
    models, mass = None, None
    if top < parts:
        children = {p: 1 << int(np.clip(np.rint(np.log2(parts * n / total)), 0, np.log2(MOST_PARTS))) for p, n in counts.items()}
        shares = [(p, int(min(1.0, SAMPLE_OF_PART * children[p] / n) * 1_000_000_000) + 1) for p, n in counts.items()]
        shares = F.broadcast(spark.createDataFrame(shares, "part int, share long"))  # a row for each of 256 parts at most
        again = F.pmod(F.xxhash64("id", "v", F.lit(2)), F.lit(1_000_000_000))
        inside = points.join(shares, "part").filter(again < F.col("share")).select("part", "id", "v", F.lit(False).alias("visits"))
        visits = rows.filter(drawn < share // 4 + 1).mapInArrow(_assign(shared, counts, ids, k), schema)
        visits = visits.select("id", "v", F.col("parts")[0].alias("home"), each).filter("part != home").select("part", "id", "v", F.lit(True).alias("visits"))
        learned = inside.unionByName(visits).repartition(top, "part").sortWithinPartitions("part").mapInArrow(_learn(children, level_recall), "part int, model binary")
        models = cut(learned)
        points = cut(_within(points, counts, models, {}, {}, k).select("id", "v", F.col("found")[0].alias("part")))
        counts, ids = _counts(points)
    few = int(min(1.0, CALIBRATION_ROWS / total) * 1_000_000_000) + 1
    few = rows.filter(F.pmod(F.xxhash64("id", "v", F.lit(3)), F.lit(1_000_000_000)) < few).select("id", "v").toArrow()
    if index.parts > 1 and few.num_rows:
        known, probe = few.column("id").to_numpy(), vectors(few.column("v"))
        truth = _truth(points, known, probe, k)
        upper = truth[:, 1] // MOST_PARTS if models is not None else truth[:, 1]
        if len(truth):
            index.mass = _quantile(index.before(probe)[truth[:, 0], upper], level_recall)
        if len(truth) and models is not None:
            pairs = sorted({(int(a), int(b)) for a, b in zip(truth[:, 0], upper)})
            visited = spark.createDataFrame([(a, probe[a].tolist(), b) for a, b in pairs], "id long, v array<double>, part int")
            before = {(r["id"], r["part"]): r["found"] for r in _within(visited, {b: 1 for _, b in pairs}, models, {}, {}, 0).collect()}
            mass = _quantile(np.array([before[int(a), int(b) // MOST_PARTS][int(b) % MOST_PARTS] for a, b in truth]), level_recall)
        shared = spark.sparkContext.broadcast(index)
    asked = rows.filter(F.col("id") % query_modulus == 0).mapInArrow(_assign(shared, top_counts, top_ids, k), schema)
    asked = cut(asked.select("id", "v", each))
    q_counts = {r[0]: r[1] for r in asked.groupBy("part").count().collect()}
    if models is not None and q_counts:
        asked = cut(_within(asked, q_counts, models, counts, ids, k, mass).select("id", "v", F.explode("found").alias("part")))
        q_counts = {r[0]: r[1] for r in asked.groupBy("part").count().collect()}
    if not q_counts:
        return empty

    both = [(p, -(-counts[p] // POINTS), -(-n // QUERIES)) for p, n in q_counts.items() if counts.get(p)]
    deal = F.broadcast(spark.createDataFrame(both, "part int, point_blocks long, query_blocks long"))  # 65 536 rows at most
    some, zero = F.xxhash64("id", "v"), F.lit(0).cast("long")
    placed = points.join(deal, "part").withColumn("mine", F.pmod(some, "point_blocks")).withColumn("theirs", F.explode(F.sequence(zero, F.col("query_blocks") - 1)))
    put = asked.join(deal, "part").withColumn("theirs", F.pmod(F.xxhash64("id", "v", F.lit(1)), "query_blocks")).withColumn("mine", F.explode(F.sequence(zero, F.col("point_blocks") - 1)))
    task = F.xxhash64("part", "mine", "theirs")
    met = placed.select(task.alias("task"), F.lit(False).alias("query"), "id", "v").unionByName(put.select(task.alias("task"), F.lit(True).alias("query"), "id", "v"))
    moved = 8 * dims * sum(counts[p] * blocks for p, _, blocks in both)
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-moved // TASK_BYTES))
    found = met.repartition(width, "task").sortWithinPartitions("task").mapInArrow(_search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
