"""Ids by pieces of many texts at once."""

from __future__ import annotations

import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quire.llm import tokens

PATH = tokens.default_path()
ODD = ["a", "b", "Z", "é", "ß", "×", "÷", "ŉ", "1", "½", ".", ",", "'", "'s", "'re", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\x1c", "\x00", "\x85", "\xa0", " ", "　", "​", "’s", "中", "é", "🙂", "-", "<|endoftext|>"]


@pytest.fixture
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_work_follows_distinct_parts(library):
    """Thousands of different pieces made of a few words and marks take no Python call each, and are encoded once."""
    words = [f"{a}{b}" for a in ("tha", "ern", "lich", "ouê") for b in ("ing", "tion", "ß", "quer", "ha")]
    text = " ".join(f"{x}{m}\n{y}" for x in words for y in words for m in (".", ",", ";", "!?", ":", ")"))
    calls = []
    tokens.forget()
    tokens.encode(["a"], PATH)
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        got = tokens.encode([text], PATH)
    finally:
        sys.setprofile(None)
    assert np.frombuffer(got[0], "<u4").tolist() == library(text)
    assert len(calls) < 600  # the text has 2,400 pieces between spaces


@pytest.mark.parametrize("together", [1, 64, 8 << 20])
def test_many_odd_texts(library, monkeypatch, together):
    monkeypatch.setattr(tokens, "TOGETHER", together)
    some = random.Random(together)
    texts = [None, "", *("".join(some.choices(ODD, k=some.randint(0, 9))) for _ in range(600))]
    ids, ends = tokens.encoded(pa.array(["cut off", *texts])[1:], PATH, 50, 7)
    assert ends[0] == 0 and ends[-1] == len(ids) and len(ends) == len(texts) + 1
    for text, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == [*library(text), 7]
    ids, ends = tokens.encoded(pa.array([], pa.string()), PATH)
    assert (len(ids), ends.tolist()) == (0, [0])
