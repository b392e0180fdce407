"""Look-ups against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import lookup
from quire.operators import predicates as E


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("ab é漢\n") for _ in range(rng.randint(0, 60)))
    rows = [(d % 3 if d % 7 else None, d, text() if d % 11 else None, "x") for d in range(120)] + [(0, 500, "ab" * 9000, "long")]
    return spark.createDataFrame(rows, "task long, doc_id long, text string, more string").cache()


VALUES = ["a", "ab", "ba", "漢", "é漢", "bab ", "\n", "zz", "", None, "ab", "abab"]


def places(text, v):
    return [i + 1 for i in range(len(text) - len(v) + 1) if text.startswith(v, i)]


@pytest.mark.parametrize("most", [200_000, 2])
def test_occurrences(spark, docs, monkeypatch, most):
    """Overlapping and repeated places, values inside of values; several passes give the same."""
    monkeypatch.setattr(lookup, "MOST_VALUES", most)
    values = spark.createDataFrame([(v,) for v in VALUES], "v string")
    got = sorted((r.doc_id, r.v, r.position, r.n) for r in lookup.occurrences(docs, values, "v").collect())
    want = []
    for r in docs.collect():
        for v in {v for v in VALUES if v}:
            if at := places(r.text or "", v):
                want.append((r.doc_id, v, at[0], len(at)))
    assert got == sorted(want)


def test_holders_and_evidence(spark, docs):
    values = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = sorted((r.i, r.doc_id) for r in E.holders(docs, values, "v").collect())
    assert got == sorted((i, d) for i, v in enumerate(VALUES) if v for d, t in text.items() if v in t)
    shown = {r.i: r for r in lookup.evidence(docs, values, "v", before=3, length=9).collect()}
    for i, v in enumerate(VALUES):
        holding = [d for d, t in text.items() if v and v in t]
        assert (i in shown) == bool(holding)
        if holding:
            at = text[min(holding)].index(v)
            start = max(0, at - 3)
            assert (shown[i].doc_id, shown[i].position, shown[i].snippet) == (min(holding), at + 1, text[min(holding)][start : start + 9])
    clause = E.Clause({"x": ["漢", "zz"], "y": ["abab", "ba"]})
    some = {r.doc_id for r in E.holding_any(docs, clause).collect()}
    assert some == {d for d, t in text.items() if "漢" in t and ("abab" in t or "ba" in t)}
    assert lookup.occurrences(docs, values.limit(0), "v").count() == lookup.occurrences(docs.limit(0), values, "v").count() == 0


@pytest.mark.parametrize("width", [4096, 16, 3])
def test_located(spark, docs, width):
    """Groups with null keys, null texts, equal offsets, ones before and behind all ranges."""
    r = lookup.ranges(docs, ["task"], "doc_id")
    want, at = {}, {}
    for x in sorted(docs.collect(), key=lambda x: x.doc_id):
        lo = at.get(x.task, 0)
        at[x.task] = lo + len(x.text or "") + 2
        want[x.doc_id] = (x.task, lo, at[x.task], "x" if x.doc_id != 500 else "long")
    assert {x.doc_id: (x.task, x.lo, x.hi, x.more) for x in r.collect()} == want
    rng = random.Random(width)
    asked = [(t, rng.randint(-3, at[t] + 5), i) for t in (0, 1, 2) for i in range(150)] + [(0, 7, i) for i in range(40)] + [(9, 1, 0), (0, None, 1)]
    offsets = spark.createDataFrame(asked, "task long, at long, i int")
    got = sorted((x.task, x.at, x.i, x.doc_id) for x in lookup.located(offsets, r.drop("more"), ["task"], width=width).collect())
    assert got == sorted((t, p, i, d) for t, p, i in asked if p is not None for d, (task, lo, hi, _) in want.items() if task == t and lo <= p < hi)


def test_sums_across_ranges(spark):
    """One group over several partitions: no window holds more than one of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = spark.range(20_000).selectExpr("id AS doc_id", "0 AS task", "1L AS n")
        sums = lookup.running(d, ["task"], ["doc_id"], "n")
        assert sums.where("hi <> doc_id + 1 OR lo <> doc_id").isEmpty()
        spread = d.repartitionByRange("task", "doc_id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert spread < 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
