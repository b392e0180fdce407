"""Operator 8: documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

Two sets of sizes a and b with that similarity differ in at most H = (a + b) // 7 shingles. The universe of shingle hashes
is partitioned into m segments, m by size band (a scheme). Large sets index whole segments; m is 0.4 of the size, more than
H, so at least m - H segments of two such sets agree. Small sets (below SMALL shingles) would have segments too poor to tell
sets apart, so they have about half as many and index the one-deletion neighbourhood of each as well: at least m - H // 2
segments differ by one shingle at most, and share a key then.

Which segments of a set are indexed is decided by their cost, the number of sets that hold a key, counted over all documents.
Keys are put in one order for all sets, rare ones first; a set drops its most costly segments, one fewer than the number that
must agree, and keeps every key up to the most costly one left. By the pigeonhole principle two linked sets still share a
key: of the segments in which they agree one is kept by the set that keeps fewer, and the other set keeps that key too. Keys
that no other set holds need not be indexed, so most sets drop out here, and frequent passages are hardly ever indexed.

Pairs come in waves. First each document with the smallest holder of most of its keys. Then, for keys whose holders are in
different components, pairs across components are tested inside the key's task by size and parity sketch (frequent keys are
cut into blocks, each pair of blocks a task of its own; a key all of whose holders hold another, more frequent one brings no
pair of its own and is left out): first a spanning forest of the components by the closest pairs in each task, whose edges are
fewer than the task's holders, then all pairs that pass and still join different components. Whatever passes is verified on the
exact sets.

Nulls and edge cases: a null or empty text, or one of white space, has no shingles and links with nothing; fewer than five
words are one shingle; equal texts are one class, found by equal sets; rows of one doc_id are taken as one document; a null
doc_id links with nothing but equal sets; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import cut, mix, slices, table, word_hashes
from .components import connected_components

WORDS = 5
#: Sets below this size index one-deletion neighbourhoods.
SMALL = 88
#: Segments for each shingle of a large set.
SEGMENTS = 0.4
#: Doc_ids (16 bytes each) that may be broadcast.
MOST_BROADCAST = 1_000_000
#: Keys in one task's group.
GROUP_KEYS = 2_000_000
#: Documents from which keys too frequent for one task are estimated. They rank last without being counted; results don't depend on it.
SAMPLE = 65_536
#: Holders of one key that are compared in one block.
BLOCK = 2048
#: Rows of blocks in one task.
BLOCK_ROWS = 20_000
#: Most frequent keys of each document that may stand for its other ones.
TOPS = 4
#: Pairs in a task that are held before they are reduced to a forest.
PENDING = 1 << 20
#: Cost class of keys too frequent to be counted.
HOT = 255


def shingle_sets(column: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """For each text its sorted distinct 64-bit shingle hashes."""
    words, at = word_hashes(column)
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        odd = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3)) & (2**64 - 1) | 1) for j in range(k)]
        all_of = mix(sum((words[j : n + j] * odd[j] for j in range(1, k)), words[:n] * odd[0]), 1) if n > 0 else words[:0]
        out = []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if e - s >= k:
                h = np.sort(all_of[s : e - k + 1])
                out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
            elif e > s:
                short = sum((words[s + j] * odd[j] for j in range(e - s)), np.uint64(e - s))
                out.append(mix(np.array([short]), 2))
            else:
                out.append(words[:0])
    return out


def set_key(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set."""
    with np.errstate(over="ignore"):
        return int(mix(h, 3).sum(dtype=np.uint64).astype(np.int64)), int(mix(h, 4).sum(dtype=np.uint64).astype(np.int64))


def sketch_bits(n: int) -> int:
    return min(4096, 1 << max(10, (8 * n - 1).bit_length()))


def parity(h: np.ndarray) -> bytes:
    """Parity bits of the set's hashes by their low bits: about eight for a shingle, from 1,024 to 4,096. Sets that differ in d
    shingles differ in at most d bits; a sketch's halves, added, are the sketch of half its length."""
    bits = sketch_bits(len(h))
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(x: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows) at a smaller width."""
    while x.shape[-1] > width:
        x = x[..., : x.shape[-1] // 2] ^ x[..., x.shape[-1] // 2 :]
    return x


def parity_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, n) ^ folded(y, n)).sum())


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2): set size and 128-bit key of each document's set."""

    def run(batches):
        tokens.forget()  # workers are used again from stage to stage
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                keys = [set_key(h) for h in sets]
                cols = [pa.array([len(h) for h in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", "n_shingles", "k1", "k2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long")


class Scheme:
    """m segments for sets of sizes low to high."""

    def __init__(self, number: int, low: int, high: int):
        self.number, self.low, self.high = number, low, high
        most = 2 * high // 7
        self.deletions = high < SMALL
        half = most // 2 + 1
        self.m = half + math.ceil(0.3 * half) if self.deletions else max(most + 1, math.ceil(SEGMENTS * high))
        self.edges = ((np.arange(self.m + 1, dtype=np.uint64) << np.uint64(32)) + np.uint64(self.m - 1)) // np.uint64(self.m)

    def spare(self, a: int) -> int:
        """Segments that a set of size a may drop: one fewer than must agree with any partner."""
        differ = (a + min(self.high, 4 * a // 3)) // 7
        return self.m - (differ // 2 if self.deletions else differ) - 1

    def keys(self, h: np.ndarray) -> np.ndarray:
        """A key for each segment and, with deletions, for each segment without one of its shingles; these hold the segment's
        number in their last six bits."""
        at = np.searchsorted(h >> np.uint64(32), self.edges)
        at[-1] = len(h)
        with np.errstate(over="ignore"):
            each = mix(h, 5)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each)))
            content = total[at[1:]] - total[at[:-1]]
            named = np.arange(self.m, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(self.number << 40)
            keys = mix(content + named, 6)
            if not self.deletions:
                return keys
            seg = np.repeat(np.arange(self.m), np.diff(at))
            keys = np.concatenate((keys, mix(content[seg] - each + named[seg], 6)))
            return keys & ~np.uint64(63) | np.concatenate((np.arange(self.m), seg)).astype(np.uint64)


def band_edges(most: int) -> list[int]:
    """First sizes of the bands; sizes of linked sets lie in one band or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * 16 / 9) + 1))
    return out


def plan_schemes(most: int) -> list[Scheme]:
    """Schemes for sets of up to `most` shingles."""
    edges = band_edges(2 * most)
    return [Scheme(j, low, high - 1) for j, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


def schemes_of(a: int, schemes: list[Scheme]) -> list[Scheme]:
    """A set's own scheme, and the next one if a partner may belong there."""
    j = next(k for k, s in enumerate(schemes) if a <= s.high)
    return schemes[j : j + 2] if 4 * a // 3 > schemes[j].high else schemes[j : j + 1]


def frequent_keys(docs: DataFrame, schemes: list[Scheme], total: int) -> np.ndarray:
    """Keys that would fill a quarter of a task's group or more by their share of a bounded sample."""
    every = max(1, total // SAMPLE)
    if total <= GROUP_KEYS // 4:  # no key can have that many holders
        return np.zeros(0, np.uint64)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                keys = [s.keys(h) for h in shingle_sets(part.column("text")) if len(h) > 2 for s in schemes_of(len(h), schemes)]
                key, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(run, "key long, n long")
    found = some.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8, GROUP_KEYS // 4 // every)).collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


PACKED = "grp int, high int, docs binary, schemes binary, spares binary, counts binary, keys binary, costs binary"
_PACKED = [x.split()[0] for x in PACKED.split(", ")]


def _planes(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, lowest first: what a group's numbers have in common stands together, so that it takes
    no room in a compressed shuffle, though a document has but a key or two in each of many groups."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(b: bytes, of: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(of).itemsize, -1).T).view(of).ravel()


def _packed_rows(to: np.ndarray, high: np.ndarray, entry: np.ndarray, per_entry: tuple[np.ndarray, ...], flat: np.ndarray, cost: np.ndarray) -> list[tuple]:
    """A row for each value of `to` and group of keys `high`: documents, schemes and spare segments of its entries, their numbers
    of keys, the keys' low halves and their costs; all but the last two as planes of bytes, documents as differences."""
    order = np.lexsort((entry, high, to))
    to, high, entry, flat, cost = to[order], high[order], entry[order], flat[order].astype(np.uint32), cost[order]
    if not len(to):
        return []
    cuts = np.flatnonzero(np.concatenate(([True], (to[1:] != to[:-1]) | (high[1:] != high[:-1]))))
    rows = []
    for s, e in zip(cuts.tolist(), np.append(cuts[1:], len(to)).tolist(), strict=True):
        who, many = np.unique(entry[s:e], return_counts=True)
        rows.append((int(to[s]), int(high[s]), _planes(np.diff(per_entry[0][who], prepend=0)), *(_planes(x[who]) for x in per_entry[1:]), _planes(many.astype(np.uint32)), flat[s:e].tobytes(), cost[s:e].tobytes()))
    return rows


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_PACKED)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k > 1 else pa.int32()) for k, c in enumerate(cols)], _PACKED)


def _unpacked(group: pa.Table) -> tuple[np.ndarray, ...]:
    """(document, scheme, spare, key, cost) for each key; keys of one task are told apart by group and low half."""
    read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()])
    planes = lambda c, t: [_from_planes(x, t) for x in group.column(c).to_pylist()]
    many, costs = np.concatenate(planes("counts", np.uint32)), group.column("costs").to_pylist()
    entries = [np.cumsum(x) for x in planes("docs", np.int64)], planes("schemes", np.uint8), planes("spares", np.uint32)
    high = np.repeat(group.column("high").to_numpy().astype(np.uint64) << np.uint64(32), [len(x) for x in costs])
    return *(np.repeat(np.concatenate(x), many) for x in entries), high | read("keys", np.uint32), np.frombuffer(b"".join(costs), np.uint8)


def keys_of(docs: DataFrame, schemes: list[Scheme], groups: int, hot: np.ndarray) -> DataFrame:
    """Packed keys by group of keys; hot ones, which aren't counted, by group of documents (below 0), so that a key's holders
    don't meet."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                rows = packed(part)
                if rows:
                    yield _arrow(rows)

    def packed(part):
        doc, number, spare, keys = [], [], [], []
        for sub in slices(part):
            for d, h in zip(sub.column("doc_id").to_pylist(), shingle_sets(sub.column("text")), strict=True):
                if len(h) < 3 or d is None:  # smaller sets link with equal sets only
                    continue
                for s in schemes_of(len(h), schemes):
                    doc.append(d), number.append(s.number), spare.append(s.spare(len(h))), keys.append(s.keys(h))
        if not keys:
            return []
        entry, flat = np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate(keys)
        group = ((flat >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int32)
        to, cost = group.copy(), np.zeros(len(flat), np.uint8)
        if len(hot):
            often = hot[np.minimum(np.searchsorted(hot, flat), len(hot) - 1)] == flat
            by_doc = (mix(np.array(doc, np.int64).view(np.uint64), 11) % np.uint64(groups)).astype(np.int32)[entry]
            to[often], cost[often] = -1 - by_doc[often], HOT
        return _packed_rows(to, group, entry, (np.array(doc, np.int64), np.array(number, np.uint8), np.array(spare, np.uint32)), flat, cost)

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def costed(packed: DataFrame, groups: int) -> DataFrame:
    """Keys that several sets hold, with their cost class (a logarithm of the number of holders), packed by group of documents."""

    def run(group: pa.Table) -> pa.Table:
        doc, scheme, spare, key, cost = _unpacked(group)
        if group.column("grp")[0].as_py() >= 0:
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            shared = np.zeros(len(key), bool)
            shared[order[1:]] |= same
            shared[order[:-1]] |= same
            doc, scheme, spare, key = doc[shared], scheme[shared], spare[shared], key[shared]
            order = np.lexsort((doc, key))
            doc, scheme, spare, key = doc[order], scheme[order], spare[order], key[order]
            once = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))[: len(key)]  # repeated rows of a document
            doc, scheme, spare, key = doc[once], scheme[once], spare[once], key[once]
            _, at, n = np.unique(key, return_inverse=True, return_counts=True)
            cost = np.minimum(8 * np.log2(n), HOT - 1).astype(np.uint8)[at]
            doc, scheme, spare, key, cost = (x[n[at] > 1] for x in (doc, scheme, spare, key, cost))
        order = np.lexsort((scheme, doc))
        doc, scheme, spare, key, cost = doc[order], scheme[order], spare[order], key[order], cost[order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (scheme[1:] != scheme[:-1])))[: len(doc)]
        entry, first = np.cumsum(new) - 1, np.flatnonzero(new)
        to = (mix(doc.view(np.uint64), 11) % np.uint64(groups)).astype(np.int32)
        high = (key >> np.uint64(32)).astype(np.int32)
        return pa.Table.from_batches([_arrow(_packed_rows(to, high, entry, (doc[first], scheme[first], spare[first]), key, cost))])

    return packed.groupBy("grp").applyInArrow(run, PACKED)


def kept_keys(doc: np.ndarray, scheme: np.ndarray, spare: np.ndarray, key: np.ndarray, cost: np.ndarray, deletions: np.ndarray) -> np.ndarray:
    """Which keys stay: of each document and scheme all up to the most costly one of the segments left."""
    order = np.lexsort((key, cost))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(key))
    order = np.lexsort((scheme, doc))
    d, s = doc[order], scheme[order]
    entry = np.empty(len(key), np.int64)
    entry[order] = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (s[1:] != s[:-1])))[: len(d)])
    segment = np.where(deletions[scheme], (key & np.uint64(63)).astype(np.int64), rank + 64)
    order = np.lexsort((rank, segment, entry))
    e, s = entry[order], segment[order]
    top = order[np.concatenate(((e[1:] != e[:-1]) | (s[1:] != s[:-1]), [True]))[: len(order)]]  # each segment's most costly key
    top = top[np.lexsort((-rank[top], entry[top]))]
    e = entry[top]
    first = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1]))[: len(e)])
    place = np.arange(len(e)) - np.repeat(first, np.diff(np.append(first, len(e))))
    edge = np.full(int(entry.max(initial=-1)) + 1, -1)
    at = place == spare[top]
    edge[e[at]] = rank[top[at]]
    return rank <= edge[entry]


def postings(costs: DataFrame, schemes: list[Scheme]) -> DataFrame:
    """(key, doc), each once: the keys that documents index."""
    deletions = np.array([s.deletions for s in schemes])

    def run(group: pa.Table) -> pa.Table:
        doc, scheme, spare, key, cost = _unpacked(group)
        keep = kept_keys(doc, scheme, spare, key, cost, deletions)
        doc, key = doc[keep], key[keep]
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        once = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))[: len(doc)]
        return pa.table({"key": key[once].view(np.int64), "doc": doc[once]})

    return costs.groupBy("grp").applyInArrow(run, "key long, doc long")


def few(ids: DataFrame) -> DataFrame:
    """ids for a join: broadcast if they are few, so that texts stay where they are read; beyond it Spark shuffles."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def exact_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, n, sketch, hashes) of the documents in ids."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                cols = [pa.array([len(h) for h in sets], pa.int64()), pa.array([parity(h) for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", "n", "sketch", "hashes"])

    return docs.select("doc_id", "text").join(few(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, n long, sketch binary, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked. Sizes and sketches exclude most others before the sets are read."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    p = p.where(4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b"))

    def close(batches):
        for batch in batches:
            sides = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")), strict=True)
            good = [parity_distance(x, y) <= (n + m) // 7 for n, m, x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    p = cut(p.mapInArrow(close, "a long, b long"))

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("h_a"), batch.column("h_b"), strict=True):  # one pair's sets at a time
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                inter = int((both[1:] == both[:-1]).sum())
                good.append(100 * inter >= 75 * (len(both) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    ids = few(p.select(F.col("a").alias("doc_id")).union(p.select(F.col("b").alias("doc_id"))).distinct())
    found = sets.join(ids, "doc_id", "left_semi")
    member = p.join(found.select(F.col("doc_id").alias("b"), F.col("hashes").alias("h_b")), "b")
    return cut(member.join(found.select(F.col("doc_id").alias("a"), F.col("hashes").alias("h_a")), "a").select("a", "b", "h_a", "h_b").mapInArrow(check, "a long, b long"))


def close_pairs(low: np.ndarray, high: np.ndarray, n: np.ndarray, comp: np.ndarray, sketch: list[np.ndarray], chunk: int = 1 << 20):
    """(a, b, score) in parts: row a against the rows low[a] to high[a], for pairs of different components whose sizes and
    sketches allow a link."""
    wide = np.array([len(x) for x in sketch])
    held = np.zeros((len(sketch), wide.max(initial=1)), np.uint64)
    for k, x in enumerate(sketch):
        held[k, : len(x)] = x
    many = np.maximum(high - low, 0)
    ends = np.cumsum(many)
    r = 0
    while r < len(many):
        to = max(r + 1, int(np.searchsorted(ends, (ends[r - 1] if r else 0) + chunk, "right")))
        m = many[r:to]
        a = np.repeat(np.arange(r, to), m)
        b = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + low[a]
        some = (comp[a] != comp[b]) & (4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b]))
        a, b = a[some], b[some]
        r = to
        for s in range(0, len(a), 1 << 14):
            e, f = a[s : s + (1 << 14)], b[s : s + (1 << 14)]
            far = np.zeros(len(e), np.int64)
            for p, q in np.unique(np.stack((wide[e], wide[f]), 1), axis=0):
                k = (wide[e] == p) & (wide[f] == q)
                far[k] = np.bitwise_count(folded(held[e[k], :p], min(p, q)) ^ folded(held[f[k], :q], min(p, q))).sum(1, dtype=np.int64)
            both = n[e] + n[f]
            good = far <= both // 7
            yield e[good], f[good], far[good] / both[good]


def forest(x: np.ndarray, y: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Which edges (x, y) make a spanning forest of least scores: in each round every tree takes its closest edge."""
    order = np.argsort(score, kind="stable")
    x, y = x[order], y[order]
    label, left, chosen = np.arange(max(x.max(initial=-1), y.max(initial=-1)) + 1), np.arange(len(x)), []
    while True:
        a, b = label[x[left]], label[y[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            return order[np.concatenate(chosen)] if chosen else order[:0]
        first = np.full(len(label), len(x))
        np.minimum.at(first, a, left)
        np.minimum.at(first, b, left)
        tree = np.flatnonzero(first < len(x))
        edge = first[tree]
        chosen.append(np.unique(edge))
        to = np.arange(len(label))
        to[tree] = np.where(label[x[edge]] == tree, label[y[edge]], label[x[edge]])
        both = tree[(to[to[tree]] == tree) & (tree < to[tree])]  # two trees took the same edge
        to[both] = both
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def standing(rows: DataFrame) -> DataFrame:
    """rows (key, doc, held, ...) of a key's distinct holders without keys all of whose holders hold one more frequent key."""
    mine = F.struct("held", "key")
    tops = rows.groupBy("doc").agg(F.slice(F.sort_array(F.collect_list(mine), asc=False), 1, TOPS).alias("tops"))
    both = rows.join(tops, "doc").select("key", "held", F.explode(F.filter("tops", lambda t: t > mine)).alias("top"))
    inside = both.groupBy("key", "held", F.col("top.key").alias("top")).agg(F.count("*").alias("n")).where("n = held").select("key").distinct()
    return rows.join(inside, "key", "left_anti")


def across(posts: DataFrame, comps: DataFrame, sets: DataFrame, best: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components that share a key and may be linked; best: only spanning forests of the components
    by the closest pairs, one for each task. Then the rows of posts that later waves need: components only grow together, so a
    key whose holders are in one stays without pairs."""
    rows = posts.join(comps, posts.doc == comps.id, "left").select("key", "doc", F.coalesce("component", "doc").alias("comp"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("held")).where("x <> y")
    rows = standing(cut(rows.join(mixed.select("key", "held"), "key")))
    rows = cut(rows.withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int")))
    left = rows.select("key", "doc")
    parts = max(1, -(-(rows.agg(F.sum("blocks")).first()[0] or 0) // BLOCK_ROWS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "comp")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "i", "j"), F.lit(parts)))
    # a document's sketch comes once to each task, however many keys it has there
    held = rows.select(F.col("part").alias("to"), F.col("doc").alias("doc_id")).distinct().join(sets.select("doc_id", "n", "sketch"), "doc_id")

    def run(group: pa.Table, held: pa.Table) -> pa.Table:
        key, i, j, block, doc, comp = (group.column(c).to_numpy() for c in ("key", "i", "j", "block", "doc", "comp"))
        order = np.lexsort((doc, block, j, i, key))
        key, i, j, block, doc, comp = (x[order] for x in (key, i, j, block, doc, comp))
        own = held.column("doc_id").to_numpy()
        by_doc = np.argsort(own, kind="stable")
        at = by_doc[np.searchsorted(own, doc, sorter=by_doc)]
        n, each = held.column("n").to_numpy()[at], [np.frombuffer(x.as_buffer(), np.uint64) for x in held.column("sketch").combine_chunks()]
        sketch = [each[k] for k in at]
        at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        size = np.diff(np.append(at, len(key)))
        high = np.repeat(at + size, size)
        second = (i < j) & (block == j)
        first = np.repeat(at + np.add.reduceat((~second).astype(np.int64), at), size)  # where the second block begins
        low = np.where(i == j, np.arange(len(key)) + 1, np.where(second, high, first))
        pending, trees = [], np.unique(comp)

        def gathered() -> np.ndarray:
            found = np.concatenate(pending) if pending else np.zeros((0, 5), np.int64)
            return found[forest(np.searchsorted(trees, found[:, 2]), np.searchsorted(trees, found[:, 3]), found[:, 4])] if best else np.unique(found, axis=0)

        for a, b, score in close_pairs(low, high, n, comp, sketch):
            ends, sides = (np.sort(np.stack((x[a], x[b]), 1), 1) for x in (doc, comp))
            pending.append(np.column_stack((ends, sides, (score * 1e9).astype(np.int64))))
            if sum(map(len, pending)) > PENDING:
                pending = [gathered()]
        found = gathered()
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return cut(rows.groupBy("part").cogroup(held.groupBy("to")).applyInArrow(run, "a long, b long").distinct()), left


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    docs = docs.select("doc_id", "text")
    sizes = cut(profile(docs))
    # equal sets are one class, named by its smallest doc_id; only that one is indexed
    one = cut(sizes.where("n_shingles > 0").groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("class")))
    copies = sizes.where("doc_id is not null").join(one, ["n_shingles", "k1", "k2"]).groupBy("doc_id").agg(F.min(F.col("doc_id") > F.col("class")).alias("copy")).where("copy").select("doc_id")
    alone = docs.join(few(copies), "doc_id", "left_anti")
    total, words, most = sizes.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0)), F.coalesce(F.max("n_shingles"), F.lit(0))).first()
    schemes = plan_schemes(max(most, 1))
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words // GROUP_KEYS))
    hot = frequent_keys(alone, schemes, total)
    posts = postings(costed(keys_of(alone, schemes, groups, hot), groups), schemes)
    posts = cut(posts)
    held = posts.groupBy("key").agg(F.min("doc").alias("leader"), F.count("*").alias("held")).where("held > 1").select("key", "leader")
    posts = cut(posts.join(held, "key"))
    sets = cut(exact_sets(docs, posts.select(F.col("doc").alias("doc_id")).distinct()))
    stars = posts.where("doc <> leader").groupBy(F.col("leader").alias("a"), F.col("doc").alias("b")).agg(F.count("*").alias("n"))
    links = verified(stars.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"), sets)
    comps = cut(connected_components(links))
    posts = posts.select("key", "doc")
    for best in (True, False):
        pairs, posts = across(posts, comps, sets, best)
        links = links.union(verified(pairs, sets))
        comps = cut(connected_components(links))
    one = one.join(comps, one["class"] == comps.id, "left").select("n_shingles", "k1", "k2", F.coalesce("component", "class").alias("component"))
    out = sizes.join(one, ["n_shingles", "k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(t) < 5 THEN array_to_string(t, ' ') ELSE array_to_string(t[i:i + 4], ' ') END AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT DISTINCT a AS id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) c ON c.id = d.doc_id
"""
