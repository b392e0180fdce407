"""Every stage of the pipeline against plain Python on what the stage before it kept."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quire.llm import mixing, toxicity

from .helpers import ascii_lower, odd_documents, table_of
from .test_brute import components, ids_of, linked, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table_of(spark), []
    out.append(docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs.collect())
    return out


def test_toxic_documents_go(spark, stages):
    scores = {r.doc_id: r.score for r in toxicity.toxicity(table_of(spark), table_of(spark, "labels")).collect()}
    assert {r.doc_id for r in stages[1]} == {d for d, s in scores.items() if s < 0.5}
    assert len(stages[1]) > 0.8 * len(stages[0])


def test_shared_lines_go(stages):
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for r in stages[1]:
        for x in (r.text or "").split("\n"):
            held[key(x)].add(r.doc_id)
    want = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != r.doc_id)) for r in stages[1]}
    assert {r.doc_id: r.text or "" for r in stages[2]} == want
    assert all(r.n_chars == len(r.text) for r in stages[2] if r.text is not None)


def test_one_of_each_group_stays(stages):
    sets = {r.doc_id: shingles(r.text) for r in stages[2]}
    comps = components(linked(sets), sets)
    assert sorted(r.doc_id for r in stages[3]) == sorted(set(comps.values()))


def test_mix_repeats_whole_documents(spark, stages):
    docs = spark.createDataFrame(stages[3], corpus_pipeline.table(spark, SF, "documents").schema)
    taken = {r.doc_id: int(r.taken / r["size"] + 0.5) if r["size"] else 1 for r in mixing.mix(docs).collect()}
    assert Counter(r.doc_id for r in stages[4]) == Counter({d: n for d, n in taken.items() if n})
    text = {r.doc_id: r.text for r in stages[3]}
    assert all(r.text == text[r.doc_id] for r in stages[4])


def test_all_tokens_are_packed(stages):
    total = sum(len(ids_of(r.text)) + 1 for r in stages[4])
    assert sum(r.length for r in stages[5]) == total
    held = defaultdict(list)
    for r in stages[5]:
        held[r.sequence_id].append((r.offset, r.length))
    for slots in held.values():
        at = 0
        for o, n in sorted(slots):
            assert o == at
            at += n
        assert at <= 1024


def test_odd_and_empty_documents(spark):
    docs = odd_documents(spark).selectExpr("doc_id", "text", "n_chars AS lang", "source", "n AS n_chars")
    for some, rows in ((True, docs), (False, docs.limit(0))):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            rows = spark.createDataFrame(out.collect(), out.schema)
        assert (rows.count() > 0) == some
