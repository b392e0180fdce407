"""Operator 4: media columns. Netpbm and BMP bytes become numpy arrays, NPY tiles and difference hashes.

`decode` reads P1-P6, samples scaled to 8 or 16 bits where their maximum is lower, and uncompressed BMP (8 bits with palette,
24, 32 with or without masks); `area_resize` averages over exact, fractional boxes
with an integral image; `tiles` writes an array as NPY tiles of whole rows; `difference_hash` compares neighbours of a
9 x 8 area-resized grey image.

The query stores each text as the samples of a grey image 64 wide, decodes that image, writes NPY tiles to a table in the
shared folder, reads the table back and computes all features from the stored tiles. Null text: empty, so one row of zeros.
Bytes that are no image raise ValueError in `decode` and give null tiles in `media_tiles` and null features; an image without
pixels is one empty tile with a blank hash; repeated rows give equal rows; extra columns are not returned; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, written

WIDTH, TILE_ROWS = 64, 16_384


def _full_range(samples: np.ndarray, top: int) -> np.ndarray:
    """Samples of 0 to `top` as 8 or 16 bits over their whole range."""
    if samples.size and int(samples.max()) > top:
        raise ValueError(f"a sample is above {top}")
    most, kind = (255, np.uint8) if top < 256 else (65535, np.uint16)
    return samples.astype(kind) if top == most else ((samples.astype(np.int64) * most + top // 2) // top).astype(kind)


def decode_netpbm(data: bytes) -> np.ndarray:
    head, at = [], 2
    kind = data[1] - 48
    while len(head) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = head[0], head[1], head[2] if len(head) > 2 else 1
    shape = (h, w, 3) if kind in (3, 6) else (h, w)
    if kind == 1:
        bits = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:]), np.uint8)[: w * h] - 48
        return (255 * (1 - bits)).astype(np.uint8).reshape(shape)
    if not 0 < top < 65536:
        raise ValueError(f"samples up to {top}")
    if kind in (2, 3):
        return _full_range(np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: math.prod(shape)], np.int64).reshape(shape), top)
    body = data[at + 1 :]
    if kind == 4:
        row = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(body, np.uint8, row * h).reshape(h, row), axis=1)[:, :w]
        return (255 * (1 - bits)).astype(np.uint8)
    return _full_range(np.frombuffer(body, ">u2" if top > 255 else np.uint8, math.prod(shape)).reshape(shape), top)


def decode_bmp(data: bytes) -> np.ndarray:
    start, head, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP with {bits} bits, compression {packed}")
    row = (w * bits // 8 + 3) // 4 * 4
    px = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * bits // 8]
    px = px[::-1] if h > 0 else px
    if packed == 3:
        if bits != 32:
            raise ValueError(f"masks with {bits} bits")
        whole = px.copy().view("<u4")
        masks = struct.unpack_from("<3I", data, 54)
        if any(m == 0 for m in masks):
            raise ValueError("an empty mask")
        low = [(m & -m).bit_length() - 1 for m in masks]
        return np.stack([(((whole & m) >> s).astype(np.int64) * 255 // (m >> s)).astype(np.uint8) for m, s in zip(masks, low, strict=True)], -1)
    if bits == 8:
        n = (start - 14 - head) // 4
        colours = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1]
        return colours[px]
    return px.reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    if data[:1] == b"P" and data[1:2] in b"123456":
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's box, boxes with fractional edges included."""
    out = image.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        size = out.shape[axis]
        total = np.concatenate((np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)), axis)
        edge = np.arange(n + 1) * (size / n)
        low = np.minimum(edge.astype(np.int64), size)
        part = (edge - low).reshape([-1 if a == axis else 1 for a in range(out.ndim)])
        at = total.take(low, axis) + part * (total.take(np.minimum(low + 1, size), axis) - total.take(low, axis))
        out = np.diff(at, axis=axis) * (n / size)
    return out


def difference_hash(image: np.ndarray) -> str:
    if not image.size:
        return ""
    grey = image if image.ndim == 2 else image[..., :3] @ np.array([0.299, 0.587, 0.114])
    small = area_resize(grey, 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def tiles(image: np.ndarray, rows: int = TILE_ROWS) -> list[bytes]:
    out = []
    for i in range(0, max(1, len(image)), rows):
        np.save(to := io.BytesIO(), np.ascontiguousarray(image[i : i + rows]))
        out.append(to.getvalue())
    return out


def read_tiles(stored: list[bytes]) -> np.ndarray:
    return np.concatenate([np.load(io.BytesIO(t), allow_pickle=False) for t in stored])


def text_images(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, image): each text's UTF-8 bytes as a binary PGM, padded with zeros to whole rows."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, most=4 << 20)):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            images = []
            for t in texts:
                h = max(1, -(-len(t or b"") // WIDTH))
                images.append(b"P5\n%d %d\n255\n" % (WIDTH, h) + (t or b"").ljust(WIDTH * h, b"\0"))
            sizes = pa.array([len(t or b"") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(images, pa.binary())], ["doc_id", "n_bytes", "image"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, image binary")


def media_tiles(images: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, tiles): NPY tiles of each image; null where the bytes are no image."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "image", 4 << 20)):
            out = []
            for data in batch.column("image").to_pylist():
                try:
                    out.append(None if data is None else tiles(decode(data)))
                except (ValueError, IndexError, OverflowError, MemoryError, struct.error):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(out, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "tiles"])

    return images.mapInArrow(run, "doc_id long, n_bytes long, tiles array<binary>")


def features(stored: DataFrame) -> DataFrame:
    def run(batches):
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for t in (x.as_py() for x in batch.column("tiles")):  # one image at a time
                if t is None:
                    rows.append((None,) * 6)
                    continue
                image = read_tiles(t)
                payload, whole = image.tobytes(), b"".join(t)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(whole), hashlib.sha256(whole).hexdigest(), difference_hash(image)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, _ = written(media_tiles(text_images(table(spark, sf_dir, "documents"))), "tiles")
    return features(stored)
