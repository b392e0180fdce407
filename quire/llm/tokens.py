"""Token ids of whole texts with a public byte-level BPE file, for the packing and the binary-output operators.

Texts are cut into pieces at places where the pre-tokeniser always cuts, found over the bytes of many texts at once: before a
single space that stands before a visible character, around a newline between two of them, and between Latin letters, digits
and marks. Encoding the pieces one by one therefore gives the ids of the whole text. Arrow numbers a batch's distinct pieces;
the tokenizers library encodes those that a Python worker doesn't remember, and the texts' ids are gathered from the pieces'
ones. Null text: empty. `<|endoftext|>` in a text is ordinary text.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices

_MEMORIES: dict = {}
#: Pieces that a worker remembers; beyond it those that were asked for once only are forgotten.
REMEMBERED = 700_000
#: Bytes of text that are cut and numbered together.
TOGETHER = 8 << 20

_OTHER, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _SPACE, _NEWLINE = range(7)


def _kinds() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    for b in range(0x21, 0x7F):
        kind[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    kind[ord("'")], kind[ord(" ")], kind[ord("\n")] = _APOSTROPHE, _SPACE, _NEWLINE
    return kind


_KIND = _kinds()
#: First bytes of a visible character: white space above ASCII begins with 0xC2, 0xE1, 0xE2 or 0xE3.
_VISIBLE = np.array([0x21 <= b < 0x7F or b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3) for b in range(256)])
#: Whether there is a cut between kinds. A contraction begins with an apostrophe, so that nothing is cut off after one.
_CUT = np.zeros((8, 8), bool)
for _a in (_LETTER, _DIGIT, _MARK, _APOSTROPHE):
    _CUT[_a, [_SPACE, _NEWLINE]] = True
for _a in (_LETTER, _DIGIT, _MARK):
    _CUT[_a, [_b for _b in (_LETTER, _DIGIT, _MARK) if _b != _a]] = True
_CUT[[_LETTER, _DIGIT], _APOSTROPHE] = True
_CUT = _CUT.ravel()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def forget() -> None:
    """Give back a worker's memory of pieces; for stages that need the room."""
    _MEMORIES.clear()


def cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes, the ends left out, where the pre-tokeniser always cuts."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))  # U+00C0 to U+017F, letters but for two signs
    lead = lead[lead + 1 < len(data)]
    lead = lead[(data[lead] != 0xC3) | (data[lead + 1] & 0xDF != 0x97)]
    kind[lead] = kind[lead + 1] = _LETTER
    cut = _CUT[kind[:-1] << 3 | kind[1:]]
    at = np.flatnonzero(data[:-1] == 0x20)
    at = at[_VISIBLE[data[at + 1]] & (at > 0)]
    cut[at - 1] = True
    at = np.flatnonzero(data[:-1] == 0x0A)
    at = at[(at > 0) & (kind[at + 1] >= _LETTER) & (kind[at + 1] <= _APOSTROPHE)]
    at = at[(kind[at - 1] >= _LETTER) & (kind[at - 1] <= _APOSTROPHE)]
    cut[at] = True
    return np.flatnonzero(cut) + 1


def joined(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs (start, size), one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Memory:
    """A tokenizer, and the pieces that it encoded: where each one's ids begin in `ids`, their number, how often asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        size = self.tok.get_vocab_size()
        self.after_space = np.array([(self.tok.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.newline = self.tok.encode("\n", add_special_tokens=False).ids
        self.known: dict[str, int] = {}
        self.ids, self.start, self.size, self.asked = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def age(self, most: int) -> None:
        if len(self.known) <= most:
            return
        stay = self.asked > 1
        if stay.sum() > most // 2:
            stay[:] = False
        names = [p for p, s in zip(self.known, stay.tolist(), strict=True) if s]
        self.known = dict(zip(names, range(len(names)), strict=True))
        size = self.size[stay]
        self.ids = self.ids[joined(self.start[stay], size)]
        self.size, self.start, self.asked = size, np.cumsum(size) - size, np.zeros(len(size), np.int64)

    def _encoded(self, new: list[str], together: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of pieces. Many stand in a text: each begins with a token that holds a space, or a newline
        stands between two."""
        spaced, bare, odd = [], [], []
        for k, p in enumerate(new):
            if p[0] == " " and p.split() == [p[1:]]:
                spaced.append(k)
            elif len(self.newline) == 1 and p.split() == [p]:
                bare.append(k)
            else:
                odd.append(k)
        found: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        for some, between in ((spaced, ""), (bare, "\n")):
            groups = [some[i : i + together] for i in range(0, len(some), together)]
            texts = [between.join([new[k] for k in g]) for g in groups]
            for group, e in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                if between:
                    stops = ids == self.newline[0]
                    size = np.diff(np.concatenate(([-1], np.flatnonzero(stops), [len(ids)]))) - 1
                    ids = ids[~stops]
                else:
                    size = np.diff(np.append(np.flatnonzero(self.after_space[ids]), len(ids)))
                if len(size) == len(group) and size.sum() == len(ids):
                    found.append((group, ids, size))
                else:
                    odd += group
        for k, e in zip(odd, self.tok.encode_batch_fast([new[k] for k in odd], add_special_tokens=False), strict=True):
            found.append(([k], np.array(e.ids, np.uint32), np.array([len(e.ids)])))
        which = np.array([k for g, _, _ in found for k in g], np.int64)
        size = np.concatenate([np.zeros(0, np.int64), *(s for _, _, s in found)])
        order = np.argsort(which)
        ids = np.concatenate([np.zeros(0, np.uint32), *(i for _, i, _ in found)])
        return ids[joined((np.cumsum(size) - size)[order], size[order])], size[order]

    def places(self, pieces: list[str]) -> np.ndarray:
        """The number of each distinct piece; new ones are encoded."""
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [pieces[k] for k in missing.tolist()]
            ids, size = self._encoded(new)
            at[missing] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(new, at[missing].tolist(), strict=True))
            self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
            self.ids, self.size, self.asked = np.append(self.ids, ids), np.append(self.size, size), np.append(self.asked, np.zeros(len(new), np.int64))
        self.asked[at] += 1
        return at


def _part(column: pa.Array, memory: Memory, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset)
    data, bounds = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]], (bounds - bounds[0]).astype(np.int64)
    mark = np.zeros(len(data) + 1, bool)
    mark[cuts(data)] = True
    mark[bounds] = True
    at = np.flatnonzero(mark).astype(np.int32)
    if at[0]:
        at = np.concatenate((np.zeros(1, np.int32), at))
    pieces = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
    where = memory.places(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
    size = memory.size[where]
    ends = np.concatenate(([0], np.cumsum(size)))
    ids = memory.ids[joined(memory.start[where], size)]
    to = ends[np.searchsorted(at, bounds)]
    if end is None:
        return ids, to
    with_end = np.full(len(ids) + len(column), end, np.uint32)
    stay = np.ones(len(with_end), bool)
    to = to + np.arange(len(to))
    stay[to[1:] - 1] = False
    with_end[stay] = ids
    return with_end, to


def encoded(column: pa.Array, path: str, remembered: int = REMEMBERED, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the texts' ids one after another, with the id `end` after each text if it is given, and where each text's
    begin, and the end."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _MEMORIES:
        _MEMORIES[path] = Memory(path)
    memory = _MEMORIES[path]
    found, ends, n = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
    for part in slices(pa.RecordBatch.from_arrays([column], ["text"]), most=TOGETHER):
        memory.age(remembered)
        ids, to = _part(part.column("text"), memory, end)
        found.append(ids)
        ends.append(to[1:] + n)
        n += len(ids)
    return np.concatenate(found), np.concatenate(ends)


def encode(texts: list[str | None], path: str, remembered: int = REMEMBERED) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text."""
    ids, ends = encoded(pa.array(texts, pa.string()), path, remembered)
    raw = memoryview(ids.astype("<u4", copy=False).tobytes())
    return [bytes(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
