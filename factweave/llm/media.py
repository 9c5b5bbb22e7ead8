"""Media columns: Netpbm and BMP images, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, small_batches

#: Rows of the payload images of documents, and the unit that payloads are filled up to.
WIDTH, UNIT, FILL = 24, 576, 255
TILE = 32
#: Samples that an image may declare beyond its bytes, and samples beyond which the integral image is kept at the borders of cells alone.
MOST_SAMPLES, WHOLE_SAMPLES = 1 << 30, 1 << 22


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """A payload of whole rows as a binary grey map."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Numbers after the magic number, past white space and comments, and where the samples start."""
    found, at = [], 2
    for _ in range(fields):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("broken header")
        found.append(int(m[1]))
        at = m.end()
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as rows x columns x channels; samples of 8 bits, wider ones scaled down."""
    kind = data[:2]
    bits = kind in (b"P1", b"P4")
    numbers, at = _header(data, 2 if bits else 3)
    wide, high = numbers[:2]
    most = 1 if bits else numbers[2]
    if not 0 < most < 65536:
        raise ValueError("broken header")
    channels = 3 if kind in (b"P3", b"P6") else 1
    if not 0 < wide * high * channels <= max(MOST_SAMPLES, len(data)):
        raise ValueError("empty or too large")
    if kind in (b"P1", b"P2", b"P3") and wide * high * channels > len(data):
        raise ValueError("too few samples")
    if kind == b"P4":
        row = (wide + 7) // 8
        raw = np.frombuffer(data, np.uint8, row * high, at).reshape(high, row)
        return (255 * (1 - np.unpackbits(raw, axis=1)[:, :wide])).astype(np.uint8)[:, :, None]
    if kind in (b"P5", b"P6"):
        raw = np.frombuffer(data, np.uint8 if most < 256 else ">u2", wide * high * channels, at)
    else:
        body = re.sub(rb"#[^\n]*", b"", data[at - 1 :])
        raw = np.array(list(re.sub(rb"\s", b"", body)) if kind == b"P1" else body.split(), np.int64)[: wide * high * channels] - (48 if kind == b"P1" else 0)
        if raw.size < wide * high * channels:
            raise ValueError("too few samples")
    raw = raw.reshape(high, wide, channels)
    if kind == b"P1":
        return (255 * (1 - raw)).astype(np.uint8)
    return raw.astype(np.uint8) if most == 255 else (raw.astype(np.int64) * 255 // most).astype(np.uint8)


def _runs(data: bytes, at: int, wide: int, rows: int, depth: int) -> np.ndarray:
    """Palette indices of an RLE4 or RLE8 bitmap, bottom row first; places left out are 0."""
    out = np.zeros((rows, wide), np.uint8)
    x = y = 0

    def put(values):
        nonlocal x
        if y >= rows or x + len(values) > wide + (depth == 4):
            raise ValueError("broken bitmap")
        values = values[: wide - x]
        out[y, x : x + len(values)] = values
        x += len(values)

    while True:
        n, value = data[at], data[at + 1]
        at += 2
        if n:
            put([value] * n if depth == 8 else [value >> 4 if k % 2 == 0 else value & 15 for k in range(n)])
        elif value == 0:
            x, y = 0, y + 1
        elif value == 1:
            return out
        elif value == 2:
            x, y = x + data[at], y + data[at + 1]
            at += 2
        else:
            size = value if depth == 8 else (value + 1) // 2
            own = data[at : at + size]
            if len(own) < size:
                raise ValueError("broken bitmap")
            put(list(own) if depth == 8 else [own[k // 2] >> 4 if k % 2 == 0 else own[k // 2] & 15 for k in range(value)])
            at += size + size % 2


def decode_bmp(data: bytes) -> np.ndarray:
    """Bitmaps of 1, 4 and 8 (palette, RLE4, RLE8), 16, 24 and 32 bits, with colour masks if they have any."""
    start, head, wide, high, _, depth, packed = struct.unpack_from("<I I i i H H I", data, 10)
    if depth not in (1, 4, 8, 16, 24, 32) or packed not in {4: (0, 2), 8: (0, 1), 16: (0, 3, 6), 32: (0, 3, 6)}.get(depth, (0,)) or wide <= 0 or not high:
        raise ValueError("unsupported bitmap")
    rows = abs(high)
    if wide * rows > max(MOST_SAMPLES, len(data)):
        raise ValueError("too large")
    if packed in (1, 2):
        raw = _runs(data, start, wide, rows, depth)
    else:
        row = (wide * depth + 31) // 32 * 4
        raw = np.frombuffer(data, np.uint8, row * rows, start).reshape(rows, row)
    if depth <= 8:
        if packed == 0 and depth < 8:
            bits = np.unpackbits(raw, axis=1).reshape(rows, -1, depth)
            raw = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)
        colours = min(struct.unpack_from("<I", data, 46)[0] or 1 << depth, 256, (start - 14 - head) // 4)
        table = np.zeros((256, 3), np.uint8)
        table[:colours] = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
        raw = table[raw[:, :wide]]
    elif packed or depth == 16:
        masks = struct.unpack_from("<3I", data, 54) if packed else (0x7C00, 0x3E0, 0x1F)
        pixels = np.ascontiguousarray(raw[:, : wide * depth // 8]).view(f"<u{depth // 8}").astype(np.int64)
        if not all(masks):
            raise ValueError("broken masks")
        low = [m & -m for m in masks]
        raw = np.stack([(((pixels & m) // s) * 255 + m // s // 2) // (m // s) for m, s in zip(masks, low, strict=True)], axis=2).astype(np.uint8)
    else:
        raw = raw[:, : wide * depth // 8].reshape(rows, wide, depth // 8)[:, :, 2::-1]
    return raw if high < 0 else raw[::-1]


def decode(data: bytes) -> np.ndarray:
    if data[:1] == b"P" and data[1:2] in b"123456":
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("unknown format")


def _bands(total: np.ndarray, cells: int) -> np.ndarray:
    """Differences of a running sum (first axis) between cells + 1 evenly spaced, interpolated places."""
    at = np.linspace(0, len(total) - 1, cells + 1)
    low = np.minimum(at.astype(np.int64), len(total) - 2)
    part = (at - low).reshape(-1, *[1] * (total.ndim - 1))
    return np.diff(total[low] * (1 - part) + total[low + 1] * part, axis=0)


def _row_bands(image: np.ndarray, cells: int) -> np.ndarray:
    """The same over the rows of a large image, whose running sum is kept only where it is read."""
    at = np.linspace(0, len(image), cells + 1)
    low = np.minimum(at.astype(np.int64), len(image) - 1)
    places = np.unique(np.concatenate([[0], low, low + 1]))
    total = np.cumsum(np.stack([np.zeros(image.shape[1:]), *[image[a:b].sum(axis=0, dtype=np.float64) for a, b in zip(places[:-1], places[1:], strict=True)]]), axis=0)
    part = (at - low)[:, None, None]
    return np.diff(total[np.searchsorted(places, low)] * (1 - part) + total[np.searchsorted(places, low + 1)] * part, axis=0)


def area_resize(image: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Means over equal areas, read off the integral image, which is interpolated inside samples."""
    rows, cols = image.shape[:2]
    if image.size > WHOLE_SAMPLES:
        bands = _row_bands(image, high)
        total = np.zeros((cols + 1, high, image.shape[2]))
        np.cumsum(bands.swapaxes(0, 1), axis=0, out=total[1:])
        sums = _bands(total, wide).swapaxes(0, 1)
    else:
        total = np.zeros((rows + 1, cols + 1, image.shape[2]), np.float64)
        np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
        sums = _bands(_bands(total, high).swapaxes(0, 1), wide).swapaxes(0, 1)
    return np.clip(np.rint(sums * (high * wide / (rows * cols))), 0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each cell of a 9 by 8 grey image is darker than its right neighbour."""
    grey = image.mean(axis=2, keepdims=True) if image.shape[2] > 1 else image
    small = area_resize(grey, 8, 9)[:, :, 0].astype(np.int16)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


ADDED = {
    "media_bytes": T.LongType(), "media_sha256": T.StringType(), "height": T.IntegerType(), "width": T.IntegerType(), "channels": T.IntegerType(), "samples": T.LongType(),
    "samples_sha256": T.StringType(), "tail_crc32": T.LongType(), "tile": T.BinaryType(), "dhash": T.StringType(), "error": T.StringType(),
}


def describe(stored: bytes | None, tile: int = TILE) -> tuple:
    """The values of ``ADDED`` for one stored image, read back from its bytes.

    Whatever is wrong with an image, it gets an error and nulls: its bytes come from anywhere.
    """
    stored = stored or b""
    head = len(stored), hashlib.sha256(stored).hexdigest()
    try:
        image = decode(stored)
        raw = image.tobytes()
        return (*head, *image.shape, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), npy(area_resize(image, tile, tile)), difference_hash(image), None)
    except Exception as e:
        return (*head, *[None] * 8, str(e) or type(e).__name__)


def text_image(text: str | None) -> bytes:
    """The bytes of a text (null: empty), filled up to whole units, as a grey map."""
    raw = (text or "").encode()
    return encode_pgm(raw + bytes([FILL]) * (UNIT - len(raw) if len(raw) < UNIT else -len(raw) % UNIT))


def media_columns(df: DataFrame, column: str = "media", tile: int = TILE, encode=None) -> DataFrame:
    """``df`` with the columns of ``ADDED``: digests of the stored image, its size, digests of its samples, tile and hash.

    The tile is an NPY array of tile x tile x channels. With ``encode``, a function from the column's
    values to stored images, these are made, read back and described in the same pass. Null, empty,
    cut-off and unknown media get an error and nulls; no row is dropped and repeated rows give
    repeated results. Columns of the added names are replaced, all others pass unchanged.
    """
    keep = [c for c in df.columns if c not in ADDED]
    schema = T.StructType([*df.select(*[f"`{c}`" for c in keep]).schema, *[T.StructField(k, v) for k, v in ADDED.items()]])
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[v.simpleString()] for v in ADDED.values()]

    def run(batches):
        for b in batches:
            rows = [describe(encode(x.as_py()) if encode else x.as_py(), tile) for x in b.column(column)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], names=[*keep, *ADDED])

    return small_batches(df.select(*[f"`{c}`" for c in keep])).mapInArrow(run, schema)


def op5_media_columns(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = media_columns(docs, "text", encode=text_image)
    feature = F.concat_ws(":", "dhash", F.lpad(F.lower(F.hex(F.crc32("tile"))), 8, "0")).alias("feature")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return found.select("doc_id", size, F.col("samples").alias("payload_bytes"), F.col("samples_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", feature, "tile")
