"""What the operators of this subpackage share: lineage cuts, byte-bounded batches, 64-bit hashing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread

PIECE_BYTES = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application: their Python need not have it on its path."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if sc.applicationId in _shipped or not package.is_dir():
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="package-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{package.name}-package.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(f"{folder}/{package.name}-package.zip")
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only where none is set (tests, local runs) a temporary folder is used;
    that is refused on a cluster, whose machines do not share it."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc._jsc.sc().getCheckpointDir().get()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no long recomputation.

    Spark deletes the shuffle files of what nothing refers to any more when the driver collects garbage. That is asked for here, as they
    would else lie on the executors' disks until it happens by itself.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    df.sparkSession._jvm.System.gc()
    return out


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` has not."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(*cols) -> F.Column:
    """A uniform double in [0, 1) from 52 bits of an md5 of the columns, the same in any SQL engine."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text each, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of rows of equal ``key`` in batches that are sorted by it; one group at a time is in memory."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if rest and rest[-1].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(part)
    if rest:
        yield pa.Table.from_batches(rest)
