"""Media columns: Netpbm and BMP to numpy arrays, area-resized by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship, utf8

TILE = 256
#: Payload bytes of one unit: 24 rows of 24 samples.
UNIT, WIDTH = 576, 24


class MediaError(ValueError):
    """Bytes that are not an image that this module reads."""


def decode(data: bytes) -> np.ndarray:
    """The samples of a Netpbm (P1 to P6) or an uncompressed BMP of 8, 24 or 32 bits, as (rows, columns) or, in
    colour, (rows, columns, 3) in the order red, green, blue. 16-bit Netpbm samples give uint16."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    raise MediaError("neither Netpbm nor BMP")


_FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        if not (m := _FIELD.match(data, at)):
            raise MediaError("Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, most = fields[0], fields[1], fields[2] if len(fields) > 2 else 1
    if not (width and height and 0 < most < 65536):
        raise MediaError("Netpbm size")
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    n = int(np.prod(shape))
    if kind < 4:
        rest = re.sub(rb"#[^\n\r]*", b"", data[at:])
        parts = [b"%d" % (x - 48) for x in rest if x in b"01"] if kind == 1 else rest.split()
        if len(parts) < n:
            raise MediaError("too few samples")
        out = np.array([int(x) for x in parts[:n]], np.uint8 if most < 256 else np.uint16)
    else:
        at += 1  # one white space ends the header
        if kind == 4:
            row = (width + 7) // 8
            packed = np.frombuffer(data, np.uint8, offset=at)
            if len(packed) < row * height:
                raise MediaError("too few samples")
            out = np.unpackbits(packed[: row * height].reshape(height, row), axis=1)[:, :width]
        else:
            sample = np.dtype(np.uint8 if most < 256 else ">u2")
            if len(data) - at < n * sample.itemsize:
                raise MediaError("too few samples")
            out = np.frombuffer(data, sample, n, at)
            out = out if most < 256 else out.astype(np.uint16)
    return (1 - out.reshape(shape)) * np.uint8(255) if kind in (1, 4) else out.reshape(shape)


def _bmp(data: bytes) -> np.ndarray:
    try:
        offset, header, width, height, _, bits, packing, _, _, _, colours = struct.unpack_from("<10xIIiiHHIIiiI", data)
    except struct.error as e:
        raise MediaError("BMP header") from e
    if header < 40 or packing or bits not in (8, 24, 32) or width <= 0 or not height:
        raise MediaError("BMP kind")
    row, rows = (width * bits // 8 + 3) // 4 * 4, abs(height)
    if len(data) < offset + row * rows:
        raise MediaError("too few samples")
    out = np.frombuffer(data, np.uint8, row * rows, offset).reshape(rows, row)[:, : width * bits // 8]
    if height > 0:
        out = out[::-1]
    if bits > 8:
        return out.reshape(rows, width, bits // 8)[:, :, 2::-1]
    n = colours or 256
    palette = np.zeros((256, 3), np.uint8)
    palette[:n] = np.frombuffer(data, np.uint8, 4 * n, 14 + header).reshape(n, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][out]
    return palette[out]


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


_GREYS = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8)


def encode_bmp(samples: np.ndarray) -> bytes:
    """Grey samples as 8 bits with a grey palette, colour as 24 bits; rows from the bottom up."""
    height, width = samples.shape[:2]
    colour = samples.ndim == 3
    line = (samples[::-1, :, ::-1] if colour else samples[::-1]).reshape(height, -1)
    line = np.pad(line, ((0, 0), (0, -line.shape[1] % 4)))
    start = 54 + (0 if colour else 1024)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + line.size, 0, 0, start, 40, width, height, 1, 24 if colour else 8, 0, line.size, 2835, 2835, 0 if colour else 256, 0)
    return head + (b"" if colour else _GREYS.tobytes()) + line.tobytes()


def grey(samples: np.ndarray) -> np.ndarray:
    """A thousand times the luma, 299 r + 587 g + 114 b, of colour; grey samples as they are."""
    return samples.astype(np.int64) @ np.array([299, 587, 114]) if samples.ndim == 3 else samples


def box_sums(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """The sums over each of height x width equal boxes, times height * width; exact for whole samples.

    The integral image of samples that are constant within their squares is linear between the corners in either
    direction, so boxes with broken edges are exact too.
    """
    rows, columns = samples.shape
    kind = np.int64 if np.issubdtype(samples.dtype, np.integer) else np.float64
    integral = np.zeros((rows + 1, columns + 1), kind)
    np.cumsum(np.cumsum(samples, axis=0, dtype=kind), axis=1, out=integral[1:, 1:])

    def at(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(parts + 1) * n
        low = np.minimum(place // parts, n - 1)
        return low, place - parts * low

    r, f = at(rows, height)
    lines = integral[r] * (height - f)[:, None] + integral[r + 1] * f[:, None]
    c, f = at(columns, width)
    corners = lines[:, c] * (width - f) + lines[:, c + 1] * f
    return np.diff(np.diff(corners, axis=0), axis=1)


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of each of height x width equal boxes."""
    return box_sums(samples, height, width) / (samples.shape[0] * samples.shape[1])


def difference_hash(samples: np.ndarray) -> str:
    """64 bits in hexadecimal: in 8 rows of 9 boxes, whether each is darker than the one to its right."""
    small = box_sums(grey(samples), 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(samples), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tiles(samples: np.ndarray, edge: int = TILE) -> Iterator[tuple[int, int, bytes, str]]:
    """(row, column, NPY bytes, difference hash) of each tile of ``edge`` samples; those at the end are smaller."""
    for y in range(0, samples.shape[0], edge):
        for x in range(0, samples.shape[1], edge):
            part = samples[y : y + edge, x : x + edge]
            yield y // edge, x // edge, npy(part), difference_hash(part)


TILE_SCHEMA = "id long, tile_row int, tile_col int, npy binary, dhash string, error string"


def media_tiles(images: DataFrame, *, id_col: str = "image_id", data_col: str = "data", edge: int = TILE) -> DataFrame:
    """(id, tile_row, tile_col, npy, dhash, error) for a column of image files, a row for each tile.

    What can't be decoded, null and empty data included, gives one row with an error and null elsewhere.
    """
    ship(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("tile_row", pa.int32()), ("tile_col", pa.int32()), ("npy", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])
        for batch in batches:
            for i, data in zip(batch.column("id").to_pylist(), batch.column("data")):
                try:
                    rows = [(i, *t, None) for t in tiles(decode(data.as_py() or b""), edge)]
                except MediaError as e:
                    rows = [(i, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    picked = images.select(F.col(id_col).cast("long").alias("id"), F.col(data_col).cast("binary").alias("data"))
    return picked.mapInArrow(run, TILE_SCHEMA).withColumnRenamed("id", id_col)


def store(payload: bytes) -> bytes:
    """A payload of whole units as a grey image 24 samples wide: a PGM if the units are odd in number, else a BMP."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_pgm(samples) if len(payload) // UNIT % 2 else encode_bmp(samples)


def round_trip(text: bytes) -> tuple:
    n = len(text)
    media = store(text + b"\xff" * (max(1, -(-n // UNIT)) * UNIT - n))
    samples = decode(media)
    payload = samples.tobytes()
    found = list(tiles(samples))
    return (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(samples), len(found), hashlib.sha256(b"".join(t[2] for t in found)).hexdigest())


ROUND_TRIP = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_tiles", pa.int64()), ("tiles_sha256", pa.string())])


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text's UTF-8 bytes, padded with bytes 255 to whole units, stored as an image and read back.

    (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_tiles,
    tiles_sha256), a row for each row. Null counts as empty, which is one unit of padding. feature is the difference
    hash of what was read back.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets, 4 << 20):
                rows = [round_trip(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), *(pa.array(c, f.type) for c, f in zip(zip(*rows), ROUND_TRIP))], ["id", *ROUND_TRIP.names])

    names = {pa.int64(): "long", pa.string(): "string"}
    schema = "id long, " + ", ".join(f"{f.name} {names[f.type]}" for f in ROUND_TRIP)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
