"""Packed segment keys: small in a compressed shuffle though the groups are many, and whole."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from quire.llm import ngram_join


class _Table:
    """Stands for a DataFrame: hands back the function that Spark runs over batches."""

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_entries_of_many_groups_are_small():
    some = random.Random(3)
    ids = [-(2**63), -5, *range(1_000_000, 1_000_300), 2**63 - 1]
    texts = [" ".join(str(some.randrange(10**6)) for _ in range(some.randint(20, 400))) for _ in ids]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], ["doc_id", "text"])
    schemes = ngram_join.plan_schemes(500)
    rows = pa.Table.from_batches(ngram_join.keys_of(_Table(), schemes, 200, np.zeros(0, np.uint64))([batch]))
    doc, scheme, spare, key, _ = ngram_join._unpacked(rows)
    got = sorted(zip(doc.tolist(), scheme.tolist(), spare.tolist(), key.tolist(), strict=True))
    want, high = [], lambda k: (k >> 32) * 200 >> 32
    for i, h in zip(ids, ngram_join.shingle_sets(batch.column("text")), strict=True):
        for s in ngram_join.schemes_of(len(h), schemes):
            want += [(i, s.number, s.spare(len(h)), high(k) << 32 | k & 0xFFFFFFFF) for k in s.keys(h).tolist()]
    assert got == sorted(want)
    held = [b"".join(r) for r in zip(*(rows.column(c).to_pylist() for c in ("docs", "schemes", "spares", "counts")), strict=True)]
    entries = sum(len(x) for x in rows.column("schemes").to_pylist())
    lz4 = pa.Codec("lz4")
    assert sum(len(lz4.compress(x, asbytes=True)) for x in held) < 7 * entries  # 17 bytes each as they are
