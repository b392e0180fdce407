"""Operator 2: token ids as Re-Pair grammars.

Documents are dealt into ranges of ascending doc_id; a range is written as shards of about `shard_tokens` ids. In a shard,
frequent pairs of ids (`least` times or more) become nonterminals, the most frequent first. Pairs are counted anew in each
round and up to `per_round` of them replaced, until no pair is frequent, the 16-bit symbols are used up (15,278 rules with a
vocabulary of 50,257), or a round replaces less than the share `worthwhile` of the pairs. No pair crosses the end of a
document, and rules have their expansion lengths, so `read_range` finds any ids of any document without decoding others.

File format: a Parquet table in the shared folder, one row a shard: part, shard; docs (int64 doc_ids), n_ids and n_symbols
(int32 for each document), rules (two uint16 for each nonterminal, numbered from `terminals`), rule_len (uint32
expansion lengths), symbols (uint16); numbers are little-endian.

Nulls and edge cases: a null text is empty and gives the end id alone; documents with equal doc_ids stand in any order; a
null doc_id comes first and is stored as the smallest long; extra columns are not stored; an empty table gives an empty
table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import slices, table, written

TERMINALS = 50_257
FORMAT = "part int, shard int, total long, docs binary, n_ids binary, n_symbols binary, rules binary, rule_len binary, symbols binary"
_NONE = np.uint16(0xFFFF)


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int = TERMINALS, least: int = 8, per_round: int = 8192, worthwhile: float = 0.005):
    """Grammar of `ids` (uint16), whose documents end before the positions `ends`.

    Returns rules (n x 2), expansion lengths of the rules, symbols, and the documents' new ends.
    """
    if terminals >= 0xFFFF or len(ids) and int(np.max(ids)) >= terminals:
        raise ValueError(f"ids must be below {terminals}, and that below 65,535")
    seq = np.asarray(ids, np.uint16)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    rules = np.zeros((0, 2), np.uint16)
    while len(seq) > 1 and terminals + len(rules) < 0xFFFF:
        pairs = (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:]
        inside = ~last[:-1]
        order = np.sort(pairs[inside])
        if not len(order):
            break
        at = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        count = np.diff(np.append(at, len(order)))
        often = np.flatnonzero(count >= least)
        room = min(per_round, 0xFFFF - terminals - len(rules))
        if len(often) > room:
            often = often[np.argpartition(-count[often], room - 1)[:room]]
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")]
        keys = order[at[often]]
        slot = lambda k: (k * np.uint32(2654435761)) >> np.uint32(16)
        held, rank_of = np.zeros(1 << 16, np.uint32), np.full(1 << 16, 0xFFFF, np.uint16)
        s = slot(keys)[::-1]  # of keys with one slot the most frequent stays, the others wait for the next round
        held[s], rank_of[s] = keys[::-1], np.arange(len(keys), dtype=np.uint16)[::-1]
        where = slot(pairs)
        rank = np.where((held[where] == pairs) & inside, rank_of[where], _NONE)
        take = rank < _NONE
        take[1:] &= rank[1:] < rank[:-1]
        take[:-1] &= rank[:-1] <= rank[1:]
        i = np.flatnonzero(take)
        used, number = np.unique(rank[i], return_inverse=True)
        new = keys[used]
        seq = seq.copy()
        seq[i] = (terminals + len(rules) + number).astype(np.uint16)
        last[i] = last[i + 1]
        stay = np.ones(len(seq), bool)
        stay[i + 1] = False
        seq, last = seq[stay], last[stay]
        rules = np.concatenate((rules, np.stack((new >> np.uint32(16), new & np.uint32(0xFFFF)), 1).astype(np.uint16)))
        if len(i) < int(worthwhile * len(pairs)):
            break
    size = [1] * terminals
    for a, b in rules.tolist():
        size.append(size[a] + size[b])
    return rules, np.array(size[terminals:], np.uint32), seq, np.flatnonzero(last) + 1


def expand(rules: np.ndarray, rule_len: np.ndarray, symbols: np.ndarray, terminals: int = TERMINALS) -> np.ndarray:
    """The ids of a run of symbols."""
    size = np.concatenate((np.ones(terminals, np.int64), rule_len.astype(np.int64)))
    begin = np.concatenate((np.arange(terminals), terminals + np.cumsum(rule_len, dtype=np.int64) - rule_len))
    flat = np.empty(terminals + int(rule_len.sum()), np.uint32)
    flat[:terminals] = np.arange(terminals)
    depth = [0] * terminals
    for a, b in rules.tolist():
        depth.append(1 + max(depth[a], depth[b]))
    depth = np.array(depth[terminals:], np.int64)
    for level in range(1, int(depth.max(initial=0)) + 1):  # what a rule stands for lies in levels below
        k = np.flatnonzero(depth == level)
        a, b = rules[k, 0], rules[k, 1]
        for part, to in ((a, begin[terminals + k]), (b, begin[terminals + k] + size[a])):
            m = size[part]
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            flat[np.repeat(to, m) + step] = flat[np.repeat(begin[part], m) + step]
    n = size[symbols]
    ends = np.cumsum(n)
    return flat[np.repeat(begin[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def shard_row(part: int, shard: int, docs: np.ndarray, n: np.ndarray, ids: np.ndarray) -> tuple:
    rules, size, symbols, ends = compress(ids, np.cumsum(n))
    le = lambda a, t: np.ascontiguousarray(a, t).tobytes()
    return part, shard, int(n.sum()), le(docs, "<i8"), le(n, "<i4"), le(np.diff(ends, prepend=0), "<i4"), le(rules, "<u2"), le(size, "<u4"), le(symbols, "<u2")


def read_range(row, i: int, start: int, count: int, terminals: int = TERMINALS) -> np.ndarray:
    """Ids start to start + count (or its end) of document i of a shard. Symbols and rules outside the range are skipped by
    their expansion lengths; only rules that reach into it are opened."""
    n = np.frombuffer(row["n_symbols"], "<i4")
    symbols = np.frombuffer(row["symbols"], "<u2", int(n[i]), 2 * int(n[:i].sum()))
    rules, rule_len = np.frombuffer(row["rules"], "<u2").reshape(-1, 2), np.frombuffer(row["rule_len"], "<u4")
    size = np.ones(len(symbols), np.int64)
    size[symbols >= terminals] = rule_len[symbols[symbols >= terminals] - terminals]
    ends = np.cumsum(size)
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + count, "left")
    out, todo = [], [int(s) for s in symbols[first : last + 1][::-1]]
    skip = start - (int(ends[first - 1]) if first else 0)
    while todo and len(out) < count:
        s = todo.pop()
        length = int(rule_len[s - terminals]) if s >= terminals else 1
        if length <= skip:
            skip -= length
        elif s < terminals:
            out.append(s)
        else:
            a, b = rules[s - terminals].tolist()
            todo += [b, a]
    return np.array(out, np.uint32)


def read_document(row, i: int) -> np.ndarray:
    """All ids of document i of a shard."""
    return read_range(row, i, 0, int(np.frombuffer(row["n_ids"], "<i4")[i]))


def write_shards(docs: DataFrame, end_id: int = 0, path: str | None = None, shard_tokens: int = 2_000_000) -> tuple[DataFrame, str]:
    path = path or tokens.default_path()
    names = [c.split()[0] for c in FORMAT.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]

    def run(batches):
        part, shard, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            r = shard_row(part, shard, *map(np.concatenate, zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(r, types, strict=True)], names)

        for batch in batches:
            for piece in slices(batch, most=tokens.TOGETHER):
                docs = pc.fill_null(piece.column("doc_id"), -(2**63)).to_numpy()
                ids, ends = tokens.encoded(piece.column("text"), path, end=end_id)
                i = 0
                while i < len(docs):
                    j = min(len(docs), int(np.searchsorted(ends, ends[i] + shard_tokens - size)))
                    held.append((docs[i:j], np.diff(ends[i : j + 1]), ids[ends[i] : ends[j]]))
                    size += int(ends[j] - ends[i])
                    i = j
                    if size >= shard_tokens:
                        yield row()
                        shard, held, size = shard + 1, [], 0
        if held:
            yield row()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(run, FORMAT), "repair")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_symbols): where each document lies and what decoding it gives."""
    parts = shards.groupBy("part").agg(F.sum("total").alias("_n"))  # a row for each range
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_part_start"))
    shard_start = F.sum("total").over(Window.partitionBy("part").orderBy("shard")) - F.col("total")
    starts = shards.select("part", "shard", shard_start.alias("_in_part"), "total").drop("total")
    starts = starts.join(F.broadcast(parts), "part").select("part", "shard", (F.col("_in_part") + F.col("_part_start")).alias("start"))
    placed = shards.join(starts, ["part", "shard"]).select("start", "docs", "n_ids", "n_symbols", "rules", "rule_len", "symbols")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                docs, n, m = np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["n_ids"], "<i4").astype(np.int64), np.frombuffer(r["n_symbols"], "<i4")
                ids = expand(np.frombuffer(r["rules"], "<u2").reshape(-1, 2), np.frombuffer(r["rule_len"], "<u4"), np.frombuffer(r["symbols"], "<u2")).astype("<u4")
                ends = np.cumsum(n)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                cols = [pa.array(docs, mask=docs == -(2**63)), pa.array(r["start"] + ends - n), pa.array(n), pa.array(crc, pa.int64()), pa.array(m, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "n_symbols"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, _ = write_shards(table(spark, sf_dir, "documents"))
    return read_shards(shards)
