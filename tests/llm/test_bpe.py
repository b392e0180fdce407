"""Operator 12 against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm import bpe, tokens

from .helpers import LONG, odd_documents, table_of

PATH = tokens.default_path()
ALPHABETS = ["ab", "aA1 '", "'strevmdl ", " \n\t", "!?'s", "漢字。，", "éáß ", " 　 x", "0123", "<|endoftext|>", "a'rel!\n ", "\x1c\x85​ a", "😀👍 a", "العربية "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def by_leaves(text, leaf, specials=True):
    t = bpe.tree(PATH, specials)
    parts = t.leaves(text, leaf)
    assert "".join(parts) == text
    return t.join_all([np.frombuffer(x, "<u4") for x in t.encode(parts)]).tolist()


def texts(seed, most):
    rng = random.Random(seed)
    for alphabet in ALPHABETS:
        for _ in range(12):
            yield "".join(rng.choice(alphabet) for _ in range(rng.randint(0, most)))
    for _ in range(40):  # runs of different alphabets
        yield "".join("".join(rng.choice(a) for _ in range(rng.randint(1, most // 4))) for a in rng.choices(ALPHABETS, k=4))
        yield "".join(rng.choice(["<|endoftext|>", "a", " ", "\n", "'", "re", "x y"]) for _ in range(most // 3))


@pytest.mark.parametrize("leaf", [1, 2, 3, 5, 17])
def test_leaves_of_any_size(library, leaf):
    for text in texts(leaf, 60):
        assert by_leaves(text, leaf) == ids_of(library, text), text


@pytest.mark.parametrize("small", [0, 7, 40])
def test_windows_of_tokens(library, monkeypatch, small):
    """No window is encoded as a whole text: cuts are compared and tokens of long runs agree."""
    monkeypatch.setattr(bpe, "SMALL", small)
    for leaf in (4, 33, 150):
        for text in texts(small + leaf, 500):
            assert by_leaves(text, leaf) == ids_of(library, text), text


def test_long_unsplit_runs(library):
    rng = random.Random(5)
    for alphabet in ("abcdefghij", "e", "<>=-", " ", "漢字仮名", "0123456789", "'s", "\n "):
        text = "".join(rng.choice(alphabet) for _ in range(20_000))
        for x in (text, text + " end", "start " + text, text + "'re" + text[:3000]):
            assert by_leaves(x, 1000) == ids_of(library, x)


def test_ordinary_specials(library):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    text = "a <|endoftext|> b<|endoftext|>c"
    assert by_leaves(text, 4, specials=False) == t.encode(text, add_special_tokens=False).ids


def want(library, text):
    ids = ids_of(library, text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["small", "odd", "empty"])
def test_query(spark, library, tmp_path, kind):
    docs = table_of(spark) if kind == "small" else odd_documents(spark)
    if kind != "small":
        docs = docs.select("doc_id", "text").union(spark.createDataFrame([(None, LONG), (99, LONG * 5 + "<|endoftext|>" + LONG)], "doc_id long, text string"))
    docs = docs.limit(0) if kind == "empty" else docs
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.query(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((r.doc_id, *want(library, r.text)) for r in docs.collect()), key=repr)


def test_rows_and_columns_stay(spark, library):
    rows = [(1, LONG, "x", 1), (1, LONG, "x", 1), (1, LONG, "y", 2), (None, LONG, None, 3), (None, "", None, 3), (2, None, "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, ids int").selectExpr("*", "map('a', doc_id) AS rest", "'q' AS i")
    got = bpe.encode(docs, leaf=700)
    assert got.columns == ["doc_id", "key", "rest", "i", "ids"]
    listed = sorted(((r.doc_id, r.key, r.i, np.frombuffer(r.ids, "<u4").tolist()) for r in got.collect()), key=repr)
    assert listed == sorted(((d, k, "q", ids_of(library, t)) for d, t, k, _ in rows), key=repr)
    back = bpe.decode(got)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(((d, t or "") for d, t, _, _ in rows), key=repr)
    odd = spark.createDataFrame([(bytearray(np.array([127, 447], "<u4").tobytes()),), (None,)], "ids binary")
    assert [r.text for r in bpe.decode(odd).collect()] == [library.decode([127, 447], skip_special_tokens=False), None]
