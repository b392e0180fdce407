"""Operator 11 against plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import merkle

from .helpers import odd_documents, table_of


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, fields=merkle.FIELDS):
    values = [row[f] for f in fields]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests, arity):
    """The root and each leaf's steps: (digests before, digests after) in its run."""
    steps, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // arity * arity
            steps[k].append((nodes[run:i], nodes[i + 1 : run + arity]))
            at[k] = i // arity
        nodes = [H(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], steps


def brute(rows, arity=2):
    """(doc_id, leaf, subroot, root, steps) of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in groups[g]], arity) for g in names]
    root, above = tree([t[0] for t in trees], arity) if trees else (None, [])
    return [(r["doc_id"], leaf(r), t[0], root, s + up) for g, t, up in zip(names, trees, above, strict=True) for r, s in zip(groups[g], t[1], strict=True)]


def folded(h, steps):
    for before, after in steps:
        h = H(*before, h, *after)
    return h


def text_of(steps):
    return " ".join(f"{''.join(b)}:{''.join(a)}" for b, a in steps)


def odd_rows(spark):
    docs = odd_documents(spark).selectExpr("doc_id", "text", "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' WHEN doc_id = 2 THEN 'é' ELSE 'z' END AS lang", "source", "n AS n_chars")
    more = docs.where("doc_id < 9").selectExpr("CASE WHEN doc_id % 2 = 0 THEN NULL ELSE doc_id END AS doc_id", "text", "lang", "source", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS n_chars")
    return docs.union(more).union(more).selectExpr("*", "1 AS tree", "'x' AS path", "2 AS i", "3 AS leaf", "4 AS digest", "5 AS at")


@pytest.mark.parametrize("arity,height", [(2, 10), (2, 1), (2, 3), (3, 1), (3, 2)])
@pytest.mark.parametrize("kind", ["small", "odd"])
def test_manifest(spark, kind, arity, height):
    """Small blocks: several sweeps up and down, incomplete last blocks, groups of one row."""
    docs = table_of(spark) if kind == "small" else odd_rows(spark)
    got = merkle.manifest(docs, arity=arity, height=height, carry={"extra": F.lit(7)})
    assert got.columns == ["doc_id", "lang", "extra", "leaf", "subroot", "root", "proof"]
    want = [(d, h, s, root, text_of(steps)) for d, h, s, root, steps in brute([r.asDict() for r in docs.collect()], arity)]
    rows = got.withColumn("again", merkle.folded("leaf", "proof")).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(r.again == r.root for r in rows)


def test_query_of_tampered_rows(spark, tmp_path):
    docs = odd_rows(spark).drop("path", "i", "leaf", "digest", "at", "tree").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    docs = docs.union(docs.selectExpr("doc_id + 100", "text", "lang", "source", "n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    got = {r.doc_id: r for r in merkle.query(spark, str(tmp_path)).collect()}
    assert got.keys() == rows.keys()
    changed = 0
    for d, h, subroot, root, steps in brute(list(rows.values())):
        r, own = got[d], rows[d]
        if zlib.crc32(str(d).encode()) % 7 == 0 and own["n_chars"] is not None:
            own, changed = own | {"n_chars": own["n_chars"] + 1}, changed + 1
        assert (r.leaf, r.subroot, r.root) == (h, subroot, root)
        assert r.proof_sha256 == H(*[x for b, a in steps for x in b + a])
        assert r.folded_root == folded(leaf(own), steps)
        assert r.verified == (own == rows[d])
    assert changed > 2


def test_one_row_and_none(spark):
    docs = table_of(spark).where("doc_id = 3")
    (r,) = merkle.manifest(docs).collect()
    assert (r.leaf, r.subroot, r.root, r.proof) == (leaf(docs.first()),) * 3 + ("",)
    assert docs.select(merkle.folded(F.lit("h"), F.lit("")).alias("h")).first().h == "h"
    assert merkle.manifest(docs.limit(0)).collect() == []
