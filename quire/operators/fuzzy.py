"""Greedy merge of similar records without a key.

Similarity is 2 x longest common subsequence / both lengths. Candidates are lossless: within the allowed insertions and
deletions d, one of d + 1 pieces of the shorter text stands unchanged in the longer one, at most d places away; where too many
texts share a piece, one more of what it leaves is asked for. Leaders are then found in rounds: a record whose earlier similar
records are all decided is merged into the first leader among them, or leads itself; this is what a pass in record order
gives, without one task holding the records.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .records import merge_by_key

#: Records that a key may bring to each record on average before it is narrowed, and how often that is done: pieces of texts that
#: have almost everything in common multiply faster than they tell texts apart.
MOST_SHARED, MOST_ROUNDS = 100, 6


def indel_ratio(a: str, b: str) -> float:
    """Bit-parallel longest common subsequence on Python's integers."""
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        u = row & masks.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def record_text(columns: list[str]):
    """name:value pairs, lower case, punctuation as spaces."""
    pairs = F.concat_ws(" ", *[F.concat(F.lit(f"{k}:"), F.col(k)) for k in columns if not k.startswith("_")])
    return F.trim(F.regexp_replace(F.lower(pairs), r"[^\p{L}\p{N}]", " "))


def allowed(n: int, m: int, least: float) -> int:
    """Insertions and deletions that texts of n and m >= n characters allow: as many as the longer one has more, or by twos above
    that; below m - n if they are never similar."""
    d = int((1 - least) * (n + m) + 1e-9)
    return d - (d - (m - n)) % 2


@functools.lru_cache(100_000)
def pieces(n: int, d: int, kept: tuple[tuple[int, int], ...] = ()) -> list[tuple[int, int]]:
    """d + 1 pieces of what the kept places leave of n characters, so that d edits spare one; none if too little is left."""
    gaps = [(x, y) for x, y in zip([0, *(k[1] for k in kept)], [*(k[0] for k in kept), n], strict=True) if x < y]
    if sum(y - x for x, y in gaps) <= d:
        return []
    parts = [1] * len(gaps)
    while sum(parts) <= d:
        i = max(range(len(gaps)), key=lambda i: (gaps[i][1] - gaps[i][0]) / parts[i])
        parts[i] += 1
    cuts = [(x + (y - x) * i // k, x + (y - x) * (i + 1) // k) for (x, y), k in zip(gaps, parts, strict=True) for i in range(k)]
    return sorted(sorted(cuts, key=lambda c: c[0] - c[1])[: d + 1])


@functools.lru_cache(100_000)
def places(n: int, m: int, d: int, own: bool, kept: tuple[tuple[int, int, int], ...] = ()) -> list[tuple[tuple[int, int, int], ...]]:
    """kept (start, end, shift) with one more piece, in each way that d edits allow: shifts change by one with each edit, from 0
    at the start to m - n at the end. The shorter text owns the pieces and has no shifts."""
    out = []
    for x, y in pieces(n, d, tuple(k[:2] for k in kept)):
        lo, hi = max((k for k in kept if k[1] <= x), default=(0, 0, 0))[2], min((k for k in kept if k[0] >= y), default=(0, 0, m - n))[2]
        path = [0, *(k[2] for k in kept), m - n]
        spare = (d - sum(abs(b - a) for a, b in zip(path, path[1:], strict=False))) // 2
        for s in (0,) if own else range(max(-x, min(lo, hi) - spare), min(m - y, max(lo, hi) + spare) + 1):
            out.append(tuple(sorted((*kept, (x, y, s)))))
    return out


def _keys(least: float, min_length: int):
    """Rows (r, t), or (r, t, own, at) to be narrowed, to rows (r, own, at, key, more). at: both lengths, and start, end and shift
    of each piece; more: a further piece can be found."""

    def keys(batches):
        for batch in batches:
            f = batch.to_pydict()
            out: dict[str, list] = {k: [] for k in ("r", "own", "at", "key", "more")}

            def add(r, t, own, n, m, kept=(), out=out):
                d = allowed(n, m, least)
                for found in places(n, m, d, own, kept):
                    text = f"{n} {m} {[x[:2] for x in found]} " + "".join(t[x + s : y + s] for x, y, s in found)
                    key = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                    for k, v in (("r", r), ("own", own), ("at", [n, m, *itertools.chain(*found)]), ("key", key), ("more", bool(pieces(n, d, tuple(x[:2] for x in found))))):
                        out[k].append(v)

            for i, (r, t) in enumerate(zip(f["r"], f["t"], strict=True)):
                if "at" in f:
                    n, m, *flat = f["at"][i]
                    add(r, t, f["own"][i], n, m, tuple(zip(flat[::3], flat[1::3], flat[2::3], strict=True)))
                    continue
                size = len(t)
                for other in range(max(min_length, int(size * least / (2 - least))), int(size * (2 - least) / least) + 2):
                    n, m = min(size, other), max(size, other)
                    if allowed(n, m, least) >= max(1, m - n):  # equal texts are not asked for
                        for own in {size == n, size != m}:
                            add(r, t, own, n, m)
            yield pa.RecordBatch.from_arrays([pa.array(out["r"], pa.int64()), pa.array(out["own"], pa.bool_()), pa.array(out["at"], pa.list_(pa.int32())), pa.array(out["key"], pa.int64()), pa.array(out["more"], pa.bool_())], names=list(out))

    return keys


def candidates(texts: DataFrame, least: float, min_length: int = 10, most: int = MOST_SHARED) -> DataFrame:
    """(a, b) with a < b: record numbers of different texts that may have the ratio. texts: record_idx, t, each text once.

    A key that many share is narrowed: what its pieces leave of the texts has the same number of edits at most, so one of as many
    pieces of that stands unchanged too, and the key goes on with it, until few enough share it. After MOST_ROUNDS of that, all
    that share a key are paired.
    """
    t = texts.where(F.length("t") >= min_length).select(F.col("record_idx").alias("r"), "t")
    kinds, keys = "r long, own boolean, at array<int>, key long, more boolean", _keys(least, min_length)
    rows, pairs = cut(t.mapInArrow(keys, kinds)), None
    for rounds in range(MOST_ROUNDS + 1):
        sides = rows.groupBy("key").agg(F.count_if("own").alias("_x"), F.count_if(~F.col("own")).alias("_y"), F.bool_or("more").alias("_more"))
        large = cut(sides.where(F.col("_more") & (F.col("_x") * F.col("_y") > most * (F.col("_x") + F.col("_y"))) & F.lit(rounds < MOST_ROUNDS)).select("key"))
        few = rows.join(large, "key", "left_anti")
        left, right = few.where("own").select("key", F.col("r").alias("x")), few.where("NOT own").select("key", F.col("r").alias("y"))
        now = left.join(right, "key").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        pairs = now if pairs is None else pairs.union(now)
        if large.isEmpty():
            return pairs.distinct()
        rows = cut(rows.join(large, "key", "left_semi").select("r", "own", "at").join(t, "r").mapInArrow(keys, kinds).dropDuplicates(["r", "own", "at", "key"]))


def distinct_pairs(texts: DataFrame, least: float, min_length: int = 10, most: int = MOST_SHARED) -> DataFrame:
    """The candidates that have the ratio."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    p = candidates(texts, least, min_length, most)
    p = p.join(texts.select(F.col("record_idx").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("record_idx").alias("b"), F.col("t").alias("tb")), "b")
    return p.where(ratio("ta", "tb") >= least).select("a", "b")


def first_of_equal(texts: DataFrame, min_length: int = 10) -> DataFrame:
    """record_idx, t: the first record of each text that is long enough."""
    return texts.where(F.length("t") >= min_length).groupBy("t").agg(F.min("record_idx").alias("record_idx")).select("record_idx", "t")


def similar_pairs(texts: DataFrame, least: float, min_length: int = 10) -> DataFrame:
    """(a, b) with a < b: all record numbers whose texts have the ratio, equal texts too. texts: record_idx, t."""
    first = cut(first_of_equal(texts, min_length))
    each = texts.join(first.withColumnRenamed("record_idx", "_first"), "t").select("record_idx", "_first")
    found = distinct_pairs(first, least, min_length)
    alike = found.union(first.select("record_idx", "record_idx")).toDF("_x", "_y")
    p = alike.join(each.toDF("x", "_x"), "_x").join(each.toDF("y", "_y"), "_y").where((F.col("x") < F.col("y")) | (F.col("_x") != F.col("_y")))
    return p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def leaders(pairs: DataFrame) -> DataFrame:
    """(record_idx, leader) for every record that is merged into an earlier one."""
    todo = cut(pairs)
    merged = None
    while not todo.isEmpty():
        waiting = todo.select(F.col("b").alias("r")).distinct()
        lead = todo.select(F.col("a").alias("r")).distinct().join(waiting, "r", "left_anti")  # nothing earlier is undecided
        now = cut(todo.join(lead, todo.a == lead.r).groupBy("b").agg(F.min("a").alias("leader")).select(F.col("b").alias("record_idx"), "leader"))
        merged = now if merged is None else merged.union(now)
        gone = now.select(F.col("record_idx").alias("r")).union(lead)
        todo = cut(todo.join(gone, todo.a == gone.r, "left_anti").join(now, todo.b == now.record_idx, "left_anti"))
    return pairs.sparkSession.createDataFrame([], "record_idx long, leader long") if merged is None else merged


def fuzzy_merge(records: DataFrame, columns: list[str], least: float = 0.98, order: str = "record_idx") -> DataFrame:
    """Similar records as one, each column's longest value first; merge_count. Equal records have one leader, so only the first of
    them is compared with others."""
    r = records.withColumn("_t", record_text(columns))
    first = cut(first_of_equal(r.select(F.col(order).alias("record_idx"), F.col("_t").alias("t"))))
    m = leaders(distinct_pairs(first, least))
    key = first.join(m, "record_idx", "left").select(F.col("t").alias("_t"), F.coalesce("leader", "record_idx").alias("_leader"))
    r = r.join(key, "_t", "left").withColumn("_key", F.coalesce("_leader", order).cast("string"))
    return merge_by_key(r, ["_key"], columns, order=order).drop("unkeyed")
