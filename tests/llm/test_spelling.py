"""Operator 13 against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from quire.llm import spelling

from .helpers import ascii_lower, odd_documents, table_of


def brute_near(words):
    """Pairs by trying all single edits of each word over the alphabet of all."""
    alphabet, known, out = sorted(set("".join(words))), set(words), {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
        out[w] = (edits & known) - {w}
    return out


def brute(counts, ratio=2):
    near, form = brute_near(sorted(counts)), {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def found(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def brute_words(docs):
    counts = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = ascii_lower(run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("kind", ["small", "odd", "empty"])
def test_documents(spark, kind):
    docs = table_of(spark) if kind == "small" else odd_documents(spark).limit(0 if kind == "empty" else 99)
    counts = brute_words(docs)
    assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == counts
    assert found(spelling.spelling_variants(spelling.vocabulary(docs))) == brute(counts)


@pytest.mark.parametrize("most", [20_000, 3])
def test_random_words(spark, most):
    """Short alphabets, so that words have many near ones, common beginnings and ends; lists split down to the last letters."""
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 7))) for _ in range(500)} | {"x" * 20 + "".join(rng.choice("abÿ") for _ in range(4)) for _ in range(80)}
    counts = {w: rng.randint(1, 40) for w in words}
    rows = [(w, n, "more", 1) for w, n in counts.items()] + [(None, 5, "null", 2)]
    df = spark.createDataFrame(rows, "word string, n long, key string, m int")
    assert found(spelling.spelling_variants(df, most=most)) == brute(counts)


def test_same_word_in_rows_and_chains(spark):
    counts = {"house": 100, "houses": 40, "hoses": 20, "hoes": 10, "shoes": 5, "ties": 4, "tied": 4}
    df = spark.createDataFrame([(w, n // 2) for w, n in counts.items()] + [(w, n - n // 2) for w, n in counts.items()], "word string, n long")
    got = found(spelling.spelling_variants(df))
    assert got == brute(counts)
    assert got["hoes"][1] == "house" and got["ties"][0] is None


def test_ranges_are_skipped():
    """A list of far words costs a row for each beginning, not for each word."""
    words = sorted(f"{a}{b}{'tail'}{i:05d}" for a in "bcdf" for b in "aeiou" for i in range(500))
    words = sorted([*words, "zztail00000", "zztail00001"])
    assert list(spelling.near(words, [words.index("zztail00000")])) == [(len(words) - 2, len(words) - 1)]
    assert list(spelling.near(words, [])) == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(None, ratio=1)
