"""Operator 12: encode whole texts with a byte-level BPE file, long ones by tree concatenation, and decode ids.

A text of more than `leaf` code points is cut into leaves that Spark deals to all tasks, wherever the cuts fall. Their ids are
joined pairwise, level by level. A join encodes a window around the place again and grows it until both sides agree:

- In text, the window ends where the pre-tokeniser cuts whatever stands around (between a letter and a digit, before a space
  after a word, after a newline; ASCII only): outside of it both sides' ids are those of the whole text.
- In a long stretch without such a place (one run of letters, say, or a language without spaces) the pre-tokens around the
  join are found first. One that is long is not encoded again: the window takes a few tokens from either side and grows until
  its first token is the left side's token there and its last one the right side's. Merges are made by rank and then from
  the left, so a sequence of tokens is a word's encoding if two overlapping parts of it are those of theirs: the result is
  exact.

Special tokens in a text count as such, as in the library, unless `specials` is false; neither leaves nor windows cut them.

Nulls and edge cases: a null text is empty and has no ids; rows of equal ids or equal texts stay rows of their own; extra
columns pass (`ids` is replaced, `text` makes way for it); an empty table gives an empty table. Ids are little-endian
unsigned 32-bit integers. Decoding replaces what isn't UTF-8, as the library does.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import slices, table

#: Code points of a leaf; longer texts are cut.
LEAF = 16_384
#: Bytes of a window, or of a pre-token, that are encoded again as a whole.
SMALL = 512
#: Pieces of text that a worker remembers.
REMEMBERED = 300_000


def _always_cut() -> np.ndarray:
    """[a, b]: whether the pre-tokeniser always cuts between ASCII bytes a and b. Only a space joins what follows it, and only
    an apostrophe takes letters after it."""
    kind = np.full(256, "?")
    for b in range(0x21, 0x7F):
        kind[b] = "L" if chr(b).isalpha() else "N" if chr(b).isdigit() else "P"
    kind[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]], kind[0x20] = "W", "S"
    pairs = {a + b for a in "LNP" for b in "SW"} | {"LN", "LP", "NL", "NP", "PN", "PL", "WL", "WN", "WP"}
    out = np.isin(np.char.add(kind[:, None], kind[None, :]), list(pairs))
    out[ord("'"), kind == "L"] = False
    return out


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as letters: printable ones as they are, the others as those from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Tree:
    """A vocabulary's bytes, and exact encoding of joined texts."""

    def __init__(self, path: str, specials: bool = True):
        from tokenizers import Tokenizer

        self.path, self.tok = path, Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = not specials
        added = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = {t: i for i, t in added.items()} if specials else {}
        self.cuts = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.letters = _byte_letters()
        back = {c: b for b, c in self.letters.items()}
        size = self.tok.get_vocab_size()
        words = [added.get(i) or self.tok.id_to_token(i) or "" for i in range(size)]
        self.bytes = [w.encode() if i in added else bytes(back[c] for c in w) for i, w in enumerate(words)]
        self.names = [str(i) for i in range(size)]
        self.first = np.array([b[0] if b else 0 for b in self.bytes], np.uint8)
        self.last = np.array([b[-1] if b else 0 for b in self.bytes], np.uint8)
        self.size = np.array([len(b) for b in self.bytes])
        self.always, self.hard = _always_cut(), np.zeros(size, bool)
        self.ends = self.always.copy()  # a window doesn't end with white space, which is cut by what follows it
        self.ends[0x09:0x0E] = False
        self.hard[list(self.special.values())] = True

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts in one go; special tokens stand apart."""
        if not self.special or not any(s in t for s in self.special for t in texts):
            return tokens.encode(texts, self.path, REMEMBERED)
        parts = [self.cuts.split(t) for t in texts]  # odd places: specials
        ids = iter(tokens.encode([x for p in parts for x in p[::2]], self.path, REMEMBERED))
        special = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        return [b"".join(next(ids) if k % 2 == 0 else special[x] for k, x in enumerate(p)) for p in parts]

    def leaves(self, text: str, leaf: int) -> list[str]:
        """Cut anywhere but inside a special token."""
        out, at = [], 0
        inside = [m.span() for m in self.cuts.finditer(text)][::-1] if self.cuts else []
        while at < len(text):
            end = min(at + leaf, len(text))
            while inside and inside[-1][1] <= end:
                inside.pop()
            if inside and inside[-1][0] < end:
                end = inside[-1][1]
            out.append(text[at:end])
            at = end
        return out

    def join_all(self, parts: list[np.ndarray]) -> np.ndarray:
        """The ids of leaves one after another, halves joined level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else np.zeros(0, "<u4")

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of two texts as one, from the ids of each."""
        if not len(a) or not len(b) or self.hard[a[-1]] or self.hard[b[0]] or self.ends[self.last[a[-1]], self.first[b[0]]]:
            return np.concatenate([a, b])
        p, q = self._edge(a), self._edge(b[::-1], back=True)
        left, right = a[p:], b[:q]
        if self.size[left].sum() + self.size[right].sum() <= SMALL:
            window = np.array(self.tok.encode((self.text(left) + self.text(right)).decode(), add_special_tokens=False).ids, "<u4")
        else:
            window = self._join_unsplit(left, right)
        return np.concatenate([a[:p], window, b[q:]])

    def _edge(self, ids: np.ndarray, back: bool = False) -> int:
        """The last place in ids where the pre-tokeniser always cuts (the start if there is none), found in growing windows; with
        `back`, ids come reversed and the first place of the text is meant."""
        n, width = len(ids), 32
        while True:
            at = max(0, n - width)
            one, two = ids[at : n - 1], ids[at + 1 :]
            if back:
                one, two = two, one
            sure = (self.ends if back else self.always)[self.last[one], self.first[two]] | self.hard[one] | self.hard[two]
            found = np.flatnonzero(sure)
            if len(found) or not at:
                edge = at + int(found[-1]) + 1 if len(found) else 0
                return n - edge if back else edge
            width *= 4

    def _cut(self, text: str) -> list[int]:
        """Places where the pre-tokeniser cuts a text, its ends included."""
        return [0, *(end for _, (_, end) in self.tok.pre_tokenizer.pre_tokenize_str(text))]

    def _join_unsplit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """join() for a stretch in which the pre-tokeniser's cuts depend on the text around. Places count code points; `at` is
        the join's. A cut depends on what stands after it by two code points at most."""
        left, right = self.text(a).decode(), self.text(b).decode()
        at, width = len(left), 64
        while True:  # the first cut after the join that the right side has as well: later ones are the same
            ours, theirs = self._cut(left + right[:width]), [at + x for x in self._cut(right[:width])]
            sure = at + len(right) if width >= len(right) else at + width - 3
            end = min((x for x in set(ours).intersection(theirs) if at <= x <= sure), default=None)
            if end is not None:
                break
            width *= 4
        mine = self._cut(left)  # the same as ours up to some place before the join
        start = next((ours[k - 1] for k in range(1, len(mine)) if ours[k] != mine[k]), at)
        cuts = [x for x in ours if start <= x <= end]
        ids_a, ids_b = self._places(a), self._places(b)
        join, pos = int(ids_a[-1]), len(left[:start].encode())
        out, text = [a[: int(np.searchsorted(ids_a, pos))]], left + right[: end - at]
        for s, e in zip(cuts, cuts[1:], strict=False):
            word = text[s:e].encode()
            v0, v1 = pos, pos + len(word)
            pos = v1
            if len(word) <= SMALL:
                out.append(self._word(word))
                continue
            # tokens of the left side from v0 on, inside one pre-token of it; tokens of the right side up to v1, likewise
            i0 = i1 = j0 = j1 = 0
            if s in mine and s < at:
                until = v0 + len(text[s : min(e, next(x for x in mine if x > s))].encode())
                i0, i1 = int(np.searchsorted(ids_a, v0)), int(np.searchsorted(ids_a, until, "right")) - 1
            if e in theirs and e > at:
                since = v1 - len(text[max(s, max(x for x in theirs if x < e)) : e].encode())
                j0, j1 = int(np.searchsorted(ids_b, since - join)), int(np.searchsorted(ids_b, v1 - join))
            stop = int(ids_a[i1]) if i1 > i0 else v0
            begin = join + int(ids_b[j0]) if j1 > j0 else v1
            out.append(self._join_word(a[i0:i1], word[stop - v0 : begin - v0], b[j0:j1]))
        out.append(b[int(np.searchsorted(ids_b, pos - join)) :])
        return np.concatenate(out)

    def _places(self, ids: np.ndarray) -> np.ndarray:
        """Byte places of tokens, and the end."""
        return np.concatenate([[0], np.cumsum(self.size[ids])])

    def _word(self, word: bytes) -> np.ndarray:
        """The ids of one pre-token."""
        return np.array([t.id for t in self.tok.model.tokenize("".join(map(self.letters.__getitem__, word)))], "<u4")

    def _join_word(self, a: np.ndarray, gap: bytes, b: np.ndarray) -> np.ndarray:
        """The ids of one pre-token whose ends have the ids a and b in themselves; the window grows until both sides agree."""
        width = 8
        while True:
            i, j = max(0, len(a) - width), min(len(b), width)
            window = self._word(self.text(a[i:]) + gap + self.text(b[:j]))
            if (i == 0 or window[0] == a[i]) and (j == len(b) or window[-1] == b[j - 1]):
                return np.concatenate([a[:i], window, b[j:]])
            width *= 2

    def decode(self, ids: np.ndarray) -> str:
        return self.text(ids).decode("utf-8", "replace")


_TREES: dict = {}


def tree(path: str, specials: bool = True) -> Tree:
    """One for each worker and file."""
    if (path, specials) not in _TREES:
        _TREES[path, specials] = Tree(path, specials)
    return _TREES[path, specials]


def _with_ids(batch: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
    others = [c for c in batch.schema.names if c not in ("text", "ids")]
    arrays = [batch.column(c) for c in others] + [pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=[*others, "ids"])


def _encoder(path: str, specials: bool):
    def encode(batches):
        t = tree(path, specials)
        for batch in batches:
            for part in slices(batch):
                yield _with_ids(part, t.encode([x or "" for x in part.column("text").to_pylist()]))

    return encode


def _cutter(path: str, specials: bool, leaf: int):
    """A row for each leaf; the first one has the document's other columns."""

    def cut(batches):
        t = tree(path, specials)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                parts = t.leaves(one.column("text")[0].as_py(), leaf)
                rest, kind = one.column("rest"), one.schema.field("rest").type
                rest = pa.concat_arrays([rest, pa.nulls(len(parts) - 1, kind)])
                key = pa.array([one.column("key")[0].as_py()] * len(parts), pa.string())
                yield pa.RecordBatch.from_arrays([key, pa.array(range(len(parts)), pa.int32()), rest, pa.array(parts, pa.string())], names=["key", "i", "rest", "text"])

    return cut


def _joiner(path: str, specials: bool):
    def join(group: pa.Table) -> pa.Table:
        parts = {}
        for i, ids in zip(group["i"].to_pylist(), group["ids"], strict=True):
            parts.setdefault(i, np.frombuffer(ids.as_buffer(), "<u4"))
        ids = tree(path, specials).join_all([parts[i] for i in range(len(parts))]).astype("<u4").tobytes()
        rest = group.filter(pc.equal(group["i"], 0))["rest"]  # a row for each document: alike in all columns
        return pa.table({"rest": rest, "ids": pa.array([ids] * len(rest), pa.binary())})

    return join


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF, specials: bool = True) -> DataFrame:
    """docs with ids in the place of text."""
    path = path or tokens.default_path()
    others = [c for c in docs.columns if c not in ("text", "ids")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + ["ids binary"])
    docs = docs.select(*[F.col(f"`{c}`") for c in others], "text")
    long = F.coalesce(F.length("text") > leaf, F.lit(False))
    short = docs.where(~long).mapInArrow(_encoder(path, specials), schema)
    rest = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(True).alias("_row"))
    kind = f"struct<{', '.join([f'`{c}`: {kinds[c]}' for c in others] + ['_row: boolean'])}>"
    rows = docs.where(long).select(rest.alias("rest"), "text")
    rows = rows.select(F.concat(F.sha2(F.col("text").cast("binary"), 256), F.lit("-"), F.xxhash64(F.to_json("rest")).cast("string")).alias("key"), "rest", "text")
    leaves = rows.mapInArrow(_cutter(path, specials, leaf), f"key string, i int, rest {kind}, text string").repartition("key", "i")
    ids = leaves.mapInArrow(_encoder(path, specials), f"key string, i int, rest {kind}, ids binary")
    whole = ids.groupBy("key").applyInArrow(_joiner(path, specials), f"rest {kind}, ids binary")
    return short.union(whole.select(*[F.col(f"rest.`{c}`") for c in others], "ids"))


def _digester(path: str, specials: bool, most: int = 1 << 18):
    def digest(batches):
        t = tree(path, specials)
        for batch in batches:
            out = []
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_buffer() or b"", "<u4")
                listed, text = hashlib.sha256(), []
                for k in range(0, len(ids), most):
                    some = ids[k : k + most].tolist()
                    listed.update((("," if k else "") + ",".join(map(t.names.__getitem__, some))).encode())
                    text.append(b"".join(map(t.bytes.__getitem__, some)))
                text = b"".join(text).decode("utf-8", "replace").encode()
                out.append((len(ids), listed.hexdigest(), hashlib.sha256(text).hexdigest()))
            arrays = [batch.column(c) for c in batch.schema.names if c != "ids"]
            arrays += [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*[c for c in batch.schema.names if c != "ids"], "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def decode(df: DataFrame, path: str | None = None, specials: bool = True) -> DataFrame:
    """df with text in the place of ids, special tokens included."""
    path = path or tokens.default_path()
    others = [f for f in df.schema if f.name not in ("text", "ids")]

    def decoded(batches):
        t = tree(path, specials)
        for batch in batches:
            text = [t.decode(np.frombuffer(x.as_buffer(), "<u4")) if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in others], pa.array(text, pa.string())], names=[*[f.name for f in others], "text"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["text string"])
    return df.select(*[F.col(f"`{f.name}`") for f in others], "ids").mapInArrow(decoded, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ids.mapInArrow(_digester(tokens.default_path(), True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
