"""Shared helpers: the cluster's shared folder, tables, byte-level word scanning and 64-bit mixing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import ready

#: The white space of every contract here: space and 0x09-0x0D.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where it is absent and all runs on one machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jsc = spark.sparkContext._jsc.sc()
        at = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="spark-quire-")
            spark.sparkContext.setCheckpointDir(at)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """Write a Parquet table to the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply); another salt gives another function."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7) | np.uint64(1)
_B = 0x5851F42D4C957F2D
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS.get("up", ())):
        with np.errstate(over="ignore"):
            for key, base in (("up", _B), ("down", pow(_B, -1, 2**64))):
                p = np.full(max(n, 1 << 20), base, np.uint64)
                p[0] = 1
                _POWERS[key] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch of texts and, for document i, its range offsets[i]:offsets[i+1].

    Works on the Arrow buffers; a null is an empty text. Memory is about 50 bytes for each byte of text, so callers
    pass slices of a few MB.
    """
    column = column.fill_null("")
    n = len(column)
    large = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if n == 0 or offs[-1] == offs[0]:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    b = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    inside = ~_SPACES[b]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = offs[:-1][offs[:-1] < len(b)]
    start[edge] = inside[edge]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edge = offs[1:][offs[1:] > 0] - 1
    end[edge] = inside[edge]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    up, down = _powers(len(b))
    with np.errstate(over="ignore"):
        total = np.cumsum(_BYTE[_LOWER[b] if lower else b] * up[: len(b)])
        before = np.where(s > 0, total[s - 1], np.uint64(0))
        words = mix((total[e] - before) * down[s] + (e - s).astype(np.uint64))
    return words, np.searchsorted(s, offs)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 19):
    """Cut a batch into runs of rows with at most `most` bytes of text (a longer single text is a run of its own)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


#: crc32 by its definition: the table of 256 remainders from the polynomial 0xEDB88320, then a step for each byte.
CRC32 = """
remainders AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS r),
"""


def crc32_of(text: str) -> str:
    """DuckDB expression: the unsigned crc32 of ASCII and Latin-1 text in UTF-8; `r` is the remainders' column."""
    code = "unicode(x)"
    utf8 = f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN {code} < 128 THEN [{code}] ELSE [192 | ({code} >> 6), 128 | ({code} & 63)] END))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {utf8}::BIGINT[]), lambda c, b: xor(c >> 8, r[1 + (xor(c, b) & 255)])))"
