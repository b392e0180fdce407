"""Packing's pieces, without Spark: one call for each piece, its checksum."""

from __future__ import annotations

import struct
import sys
import zlib

import pyarrow as pa
from tokenizers import Tokenizer

from quire.llm import packing, tokens


class _Table:
    """Stands for a DataFrame: hands back the function that Spark runs over batches."""

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_pieces_of_a_batch():
    t = Tokenizer.from_file(tokens.default_path())
    texts = [None, "", *(f"thaing{i % 40}. ernquer\nlich{i % 7}, {'wo ' * (i % 30)}" for i in range(2000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    run = packing.token_pieces(_Table(), 16, 2, tokens.default_path())
    list(run([batch.slice(0, 2)]))
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        got = list(run([batch]))
    finally:
        sys.setprofile(None)
    want = []
    for doc, text in enumerate(texts):
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 2], 0
        for piece, to in enumerate(range((len(ids) - 1) % 16 + 1, len(ids) + 1, 16)):
            want.append((doc, piece, at, to - at, zlib.crc32(struct.pack(f"<{to - at}I", *ids[at:to]))))
            at = to
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want
    assert len(calls) < 1.5 * len(want)
