"""Operator 5: best-fit packing planned on the length histogram.

The lengths of all pieces are counted (at most `capacity` counts reach the driver). Best-fit decreasing then runs over
counts instead of documents: a step puts a run of equal pieces into a run of equally filled sequences. The plan has a few
thousand rows at any data size; pieces take their slots by rank within their length.

Nulls and edge cases: a null or empty text is a document of one token, the end id; repeated rows are packed once each;
documents longer than the capacity are cut, the first piece being the shorter one; extra columns are not returned; an
empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, slices, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one length that are ranked in one task.
RUN = 2_000


def token_pieces(docs: DataFrame, capacity: int, end_id: int, path: str, remembered: int = tokens.REMEMBERED) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, most=tokens.TOGETHER):
                ids, ends = tokens.encoded(part.column("text"), path, remembered, end_id)
                n = np.diff(ends)
                many, first = -(-n // capacity), (n - 1) % capacity + 1
                doc = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                raw, at = memoryview(ids.astype("<u4", copy=False).tobytes()), ends[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                cols = [part.column("doc_id").take(pa.array(doc)), *(pa.array(c, t) for c, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64())))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Rows (length, first rank, first sequence, offset), each for the ranks up to the next row of the length.

    Best-fit decreasing: the longest pieces first, each into the fullest sequences that still have room for them; equal
    pieces and equally filled sequences move as one run.
    """
    rows: list[tuple[int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, how many)
    rooms: list[int] = []  # heap of the keys of runs
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        aside = []
        while left and rooms:
            room = heapq.heappop(rooms)
            if room < length:
                if runs.get(room):
                    aside.append(room)
                continue
            while left and runs.get(room):
                first, n = runs[room].pop()
                used = min(n, left)
                rows.append((length, rank, first, capacity - room))
                if used < n:
                    runs[room].append((first + used, n - used))
                rank, left = rank + used, left - used
                rest = room - length
                if rest:
                    if not runs.get(rest):
                        heapq.heappush(rooms, rest)
                    runs.setdefault(rest, []).append((first, used))
            if runs.get(room):
                heapq.heappush(rooms, room)
        for room in aside:
            heapq.heappush(rooms, room)
        if left:
            per = capacity // length
            whole, more = divmod(left, per)
            for k in range(per):  # new sequences, filled with this length alone
                n = whole + (k < more and 1)
                if not n:
                    break
                rows.append((length, rank, opened, k * length))
                rank += n
            for n, first, filled in ((whole, opened, per), (1, opened + whole, more)):
                room = capacity - filled * length
                if n and filled and 0 < room:
                    if not runs.get(room):
                        heapq.heappush(rooms, room)
                    runs.setdefault(room, []).append((first, n))
            opened += whole + (more > 0)
    return rows


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces with sequence_id and offset."""
    pieces = cut(pieces)
    counted = pieces.groupBy("length").count()
    counts = {int(r[0]): int(r[1]) for r in counted.collect()}
    steps = sorted(plan(counts, capacity))
    lengths, ranks, firsts, offsets = (np.array(c, np.int64) for c in (zip(*steps, strict=True) if steps else [()] * 4))
    begins = np.searchsorted(lengths, np.arange(capacity + 2))
    # rank within length: first within runs of about RUN rows, then from the sizes of the runs before
    runs = F.broadcast(counted.select("length", F.ceil(F.col("count") / RUN).alias("_runs")))  # a row for each length
    dealt = pieces.join(runs, "length").withColumn("_run", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_runs"))).drop("_runs")
    sizes = dealt.groupBy("length", "_run").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_run")) - F.col("_n")).drop("_n")
    within = Window.partitionBy("length", "_run").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(sizes, ["length", "_run"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.zeros(len(length), np.int64)
            for n in np.unique(length):  # the plan rows of one length are in order of rank
                own = length == n
                row[own] = begins[n] + np.searchsorted(ranks[begins[n] : begins[n + 1]], rank[own], "right") - 1
            cols = [pa.array(firsts[row] + rank - ranks[row], pa.int64()), pa.array(offsets[row], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, remembered: int = tokens.REMEMBERED) -> DataFrame:
    """`remembered` bounds the tokenizer memory of a Python worker (about 250 bytes each); results don't depend on it."""
    return pack(token_pieces(docs, capacity, end_id, path or tokens.default_path(), remembered), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
