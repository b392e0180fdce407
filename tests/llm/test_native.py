"""Operators 1, 3 and 7 against plain Python."""

import base64
import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import pseudonyms, quantised, secrets

from .helpers import odd_documents, table_of
from .test_brute import components


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


PII = """call +1 (212) 555-0199, 138 or 13812345678; card 4111 1111 1111 1111 or 4111-1111-1111-1112, ssn 123-45-6789, 000-12-3456;
ip 10.0.0.255 and 256.1.1.1; born 1999-12-31, 31/12/1999, 12/31/1999, 2023-02-30; mail Jo.Doe+x@Mail.example.org. id 12345678901234567890"""


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(1, PII), (2, "so " + PII), (3, None), (4, ""), (5, "x" * 5000 + " 4111111111111111")], "doc_id long, text string").withColumn("old", F.col("text"))
    return {r.doc_id: r for r in pseudonyms.pseudonymise(docs).collect()}


def test_pseudonyms_keep_formats_and_links(found):
    one, two = found[1], found[2]
    assert [f.pseudonym for f in one.found] == [f.pseudonym for f in two.found]
    by = defaultdict(list)
    for f in one.found:
        old, new = one.old[f.start : f.end], f.pseudonym
        by[f.kind].append((old, new))
        assert new != old and len(new) == len(old) or f.kind == "ipv4" or f.kind == "email"
        if f.kind != "ipv4":
            assert re.sub(r"\d", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))) == re.sub(r"\d", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", old)))
    assert {k: len(v) for k, v in by.items()} == {"phone": 2, "card": 1, "ssn": 1, "ipv4": 1, "date": 3, "email": 1}
    assert all(luhn(n) for _, n in by["card"]) and all(0 <= int(x) <= 255 for _, n in by["ipv4"] for x in n.split("."))
    a, b, c = (n for _, n in by["date"])
    assert a.split("-") == b.split("/")[::-1] == [c.split("/")[i] for i in (2, 0, 1)]
    rest = re.split("|".join(re.escape(one.old[f.start : f.end]) for f in one.found), one.old)
    assert all(x in one.text for x in rest)
    assert "000-12-3456" in one.text and "256.1.1.1" in one.text and "2023-02-30" in one.text and "1112" in one.text
    assert found[3].text is None and found[3].found == [] and found[4].text == ""
    assert luhn(found[5].text[-16:]) and found[5].text[:5001] == "x" * 5000 + " "


def test_feistel_is_a_permutation(spark):
    n = pseudonyms._DATE_LEFT * 4
    size = F.lit(pseudonyms._DATE_LEFT).cast("long")
    d = spark.range(n).select(pseudonyms.feistel(F.floor(F.col("id") / 4), F.col("id") % 4, size, F.lit(4).cast("long"), "k", "x", F.lit("")).alias("s"))
    assert d.select("s.l", "s.r").distinct().count() == n and d.where("s.l between 0 and 228 and s.r between 0 and 3").count() == n
    two = spark.range(1000).select(pseudonyms.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "x", F.lit("")).alias("x"), pseudonyms.permute_letters(F.concat(F.lit("q"), F.lpad(F.col("id").cast("string"), 3, "0")), "k", F.lit("")).alias("y"))
    assert two.select("x").distinct().count() == two.select("y").distinct().count() == 1000


def test_phones_and_ssns_stay_valid(spark):
    texts = [f"1{3 + i % 7}{i * 7919 % 10**9:09d}" for i in range(120)] + [f"(212) {2 + i % 8}{i:02d}-{i * 37 % 10**4:04d}" for i in range(60)] + [f"{(i * 7) % 899 + 1:03d}-{i % 99 + 1:02d}-{i * 91 % 9999 + 1:04d}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "text AS old", "1 AS found")
    rows = [r for r in pseudonyms.pseudonymise(docs).collect() if r.found]
    assert len(rows) > 370 and len({r.text for r in rows}) == len({r.old for r in rows})
    for r in rows:
        kind = r.found[0].kind
        if kind == "ssn":
            assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", r.text)
        elif r.old[0] == "1":
            assert kind == "phone" and r.text[:2] == r.old[:2] and len(r.text) == 11 and r.text.isdigit()
        else:
            assert r.text.startswith("(212) ") and r.text[6] >= "2" and len(r.text) == 14


def test_pseudonyms_whole_table(spark):
    docs = table_of(spark, sf="/root/testdata/sf0.01").withColumn("old", F.col("text"))
    rows = pseudonyms.pseudonymise(docs).collect()
    cards = 0
    for r in rows:
        if not r.found:
            assert r.text == r.old
        for f in r.found:
            cards += f.kind == "card" and luhn(r.old[f.start : f.end]) and luhn(f.pseudonym)
            assert r.old[f.start : f.end] not in r.text or f.kind == "email"
    assert cards > 5 and len(rows) == docs.count()
    assert pseudonyms.pseudonymise(odd_documents(spark).limit(0)).count() == 0


BASE = {
    "assign": (re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}
KINDS = ["assign", "access", "hex", "random"]


def base_spans(text):
    return sorted((m.start(), KINDS.index(k), m.end()) for k, (p, good) in BASE.items() for m in p.finditer(text or "") if good(m))


def listed(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


RANDOM = base64.b64encode(hashlib.sha512(b"a key").digest())[:60].decode()


@pytest.mark.parametrize("which", ["small", "odd", "secret"])
def test_secrets(spark, which):
    if which == "small":
        docs = table_of(spark, sf="/root/testdata/sf0.01")
    elif which == "odd":
        docs = odd_documents(spark)
    else:
        texts = ["Password: 'hunter2x' api-key=1 token = secret = abcdefgh AKIA" + "Z" * 12 + " é " + "0a" * 20, f"x {RANDOM} y", "thenationsofthelandareheretostayandsing " * 3, "deadbeef" * 4, "passwd=short api_key=\"ABCDEFGH\"", "a" * 40 + "=" * 5, f"{RANDOM[::-1]}{RANDOM[5:40]}", "-" * 60]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.find_secrets(docs).select("doc_id", secrets.listed(F.col("base")).alias("base"), secrets.listed(F.col("found")).alias("found")).collect()}
    for d in docs.collect():
        want = listed(base_spans(d.text))
        assert rows[d.doc_id].base == want
        assert set(filter(None, want.split(","))) <= set(rows[d.doc_id].found.split(","))
    if which == "secret":
        assert "random:2:" in rows[1].found and rows[2].found == "" and rows[5].found == "hex:0:40" and rows[7].found == ""
    if which == "small":
        assert sum("random" in r.found for r in rows.values()) <= 3


def test_secrets_query_columns(spark):
    r = {x.doc_id: x for x in secrets.query(spark, "/root/testdata/sf0.001").collect()}
    for d in table_of(spark).collect():
        spans = base_spans(d.text)
        assert r[d.doc_id].base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert (r[d.doc_id].n_assign, r[d.doc_id].n_access, r[d.doc_id].n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))


def brute_vectors(rows):
    good = {}
    for v, e, label in rows:
        if v is not None and e is not None and label is not None and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e):
            good[v] = (label, np.array(e, float) / np.linalg.norm(np.array(e, float)))
    links = []
    for label in {x[0] for x in good.values()}:
        ids = [v for v in good if good[v][0] == label]
        x = np.stack([good[v][1] for v in ids])
        a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
        links += [(ids[i], ids[j]) for i, j in zip(a, b, strict=True)]
    return links


def planted_vectors(dims: int, seed: int, n: int = 3000):
    """Unit vectors of two labels: chance ones, pairs around the limit, and a hot group of near copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    move = rng.normal(size=(n, dims))
    move /= np.linalg.norm(move, axis=1)[:, None]
    near = x[: n // 3] + move[: n // 3] * rng.uniform(0, 0.5, (n // 3, 1))
    hot = x[0] + move[n // 3 : n // 3 + n // 6] * rng.uniform(0, 0.45, (n // 6, 1))
    return [(i, v.tolist(), int(i % 5 == 0)) for i, v in enumerate(np.concatenate((x, near, hot))[rng.permutation(n + n // 3 + n // 6)])]


def check_vectors(spark, rows, **how):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links = brute_vectors(rows)
    got = {r.vec_id: r for r in quantised.near_duplicate_vectors(docs, **how).collect()}
    n = np.bincount([v for x in links for v in x], minlength=max(got) + 1)
    assert all(got[v].n_links <= n[v] for v in got)
    assert sum(r.n_links for r in got.values()) >= 0.99 * 2 * len(links) > 1000
    comps = components(links, list(got))
    assert sum(got[v].component_id == comps[v] for v in got) >= 0.99 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("dims", [4, 8, 16, 64, 256])
def test_vectors_recall(spark, dims):
    check_vectors(spark, planted_vectors(dims, dims))


def test_vectors_in_finer_lists_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(quantised, "MOST_LISTS", 6)
    monkeypatch.setattr(quantised, "BLOCK", 50)
    monkeypatch.setattr(quantised, "PAIRS", 100)
    check_vectors(spark, planted_vectors(24, 1, 1500), list_size=40)


def test_vectors_of_a_plane(spark):
    """64 components, but of two dimensions only."""
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(2, 64))
    rows = [(i, (rng.normal(size=2) @ flat).tolist(), 1) for i in range(400)]
    check_vectors(spark, rows)


def test_vectors_of_other_lengths_and_labels(spark):
    rows = [(0, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (2, [2.0, 4.1], "a"), (3, [1.0, 2.0, 0.0], "a"), (4, [1.0, 2.0], "b"), (5, [1.0, 2.0, 0.0], "a"), (6, [1.0], "b"), (7, [-1.0], "b")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in quantised.near_duplicate_vectors(docs).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 5: (1, 3), 4: (0, 4), 6: (0, 6), 7: (0, 7)}


def test_vectors_odd(spark):
    e = [1.0, 0.0, 2.0]
    rows = [(0, e, 1), (1, e, 1), (2, [2.0, 0.0, 4.0], 1), (3, e, 2), (4, e, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 2.0], 1), (8, [float("nan"), 0.0, 1.0], 1), (9, [1.0, -0.0, 2.0], 1), (10, [1.0, 0.1, 2.0], 1), (11, [-1.0, 0.0, 0.0], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("many", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in quantised.near_duplicate_vectors(docs).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 9: (4, 0), 10: (4, 0), **{v: (0, v) for v in (3, 4, 5, 6, 7, 8, 11)}}
    assert quantised.near_duplicate_vectors(docs.limit(0)).count() == 0


def test_secrets_recall_by_alphabet(spark):
    """Tokens of 32 characters among ordinary documents; what is hexadecimal in lower case is a base span already."""
    rng = np.random.default_rng(5)
    alphabets = {"digits": (secrets.DIGITS, 24), "HEX": (secrets.DIGITS + "ABCDEF", 32), "base32": (secrets.UPPER + "234567", 32), "base36": (secrets.DIGITS + secrets.LOWER, 32)}
    alphabets |= {"letters": (secrets.UPPER + secrets.LOWER, 32), "base62": (secrets.UPPER + secrets.LOWER + secrets.DIGITS, 32), "base64": (secrets.UPPER + secrets.LOWER + secrets.DIGITS + "+/", 32)}
    rows = [(10**6 * (k + 1) + i, "key " + "".join(rng.choice(list(a), n)) + " end") for k, (a, n) in enumerate(alphabets.values()) for i in range(40)]
    docs = table_of(spark, sf="/root/testdata/sf0.01").select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    found = secrets.find_secrets(docs).where(F.exists("found", lambda s: s["kind"] == 3)).select("doc_id").collect()
    n = np.bincount([r.doc_id // 10**6 for r in found], minlength=len(alphabets) + 1)
    assert (n[1:] >= 0.9 * 40).all(), dict(zip(alphabets, n[1:].tolist(), strict=True))
    assert n[0] <= 0.01 * n.sum()  # false discoveries
