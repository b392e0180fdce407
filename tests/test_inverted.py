"""The stored index against the search without one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import inverted, retrieval
from quire.session import new_folder

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def chunks(spark):
    """Words by a power law, chunks of all lengths, equal chunks, blank ones."""
    rng = random.Random(3)
    pick = lambda: WORDS[int(len(WORDS) * rng.random() ** 3)]
    rows = [(d, i, rng.choice(["text", "text", "table", "code", "formula"]), " ".join(pick() for _ in range(rng.choice([0, 1, 3, 8, 20, 60])))) for d in range(700) for i in range(4)]
    rows += [(900 + d, 0, "text", "w9 w9 w300") for d in range(300)] + [(5000, 0, "table", None)]
    return spark.createDataFrame(rows, "doc_id long, idx long, type string, text string").cache()


@pytest.fixture(scope="module")
def index(spark, chunks):
    old, inverted.BLOCK = inverted.BLOCK, 16
    old_segment, inverted.SEGMENT = inverted.SEGMENT, 700
    path = new_folder(spark, "index")
    for part in range(3):
        inverted.append(chunks.where(F.col("doc_id") % 3 == part), path)
    inverted.BLOCK, inverted.SEGMENT = old, old_segment
    return path


ASKED = ["w0 w1", "w350 w399 w2", "w9 w9 w300", "absent", "w5 absent w5", "w0", "w380", ""]


def asked(spark):
    return spark.createDataFrame([(q,) for q in ASKED], "question string")


def found(df):
    return sorted(tuple(r[c] for c in ("question", "rank", "doc_id", "idx", "type", "score", "text", "method")) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10, 40])
def test_same_as_without_index(spark, chunks, index, k):
    """40 is beyond the kept first chunks; `absent` and the blank question are filled with chunks in reading order."""
    want = retrieval.search(chunks, asked(spark), k)
    assert sorted(map(repr, found(inverted.search(index, asked(spark), chunks, k)))) == sorted(map(repr, found(want)))
    assert want.count() == k * len(ASKED)


def test_blocks_are_skipped(spark, index):
    q = asked(spark).where("question LIKE 'w%'")
    some, _ = inverted.planned(spark, index, q, 5)
    every, _ = inverted.planned(spark, index, q, 5, skip=False)
    opened, there = ({r.question: r.n for r in b.groupBy("question").agg(F.count("*").alias("n")).collect()} for b in (some, every))
    assert all(opened[x] <= there[x] for x in opened)
    assert sum(opened.values()) < sum(there.values()), (opened, there)
    assert opened["w0"] < 0.8 * there["w0"], (opened, there)


def test_only_asked_buckets_are_read(spark, index):
    plan = inverted.planned(spark, index, spark.createDataFrame([("w7",)], "question string"), 5, skip=False)[0]._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^]]*)\].*?PushedFilters: \[([^]]*)\]", plan[plan.index("postings") :])
    assert "bucket#" in filters[1] and "token" in filters[2], plan


def test_append_that_failed_is_not_there(spark, chunks, index):
    """Blocks without stats are invisible; the next append takes their place."""
    path = new_folder(spark, "index")
    part = chunks.where("doc_id < 50")
    assert inverted.append(part, path) == 0
    chunks.where("doc_id >= 50").limit(3).selectExpr("'w0' AS token", "0 AS segment", "0 AS block", "1 AS n", "9 AS most_tf", "1 AS least_dl", "array(named_struct('doc_id', doc_id, 'idx', idx, 'type', type, 'tf', 1, 'dl', 1)) AS postings", "0 AS bucket").write.partitionBy("bucket").parquet(f"{path}/blocks/batch=1")
    q = spark.createDataFrame([("w0 w3",)], "question string")
    assert found(inverted.search(path, q, chunks)) == found(retrieval.search(part, q))
    assert inverted.append(chunks.where("doc_id >= 50"), path) == 1
    assert found(inverted.search(path, q, chunks)) == found(retrieval.search(chunks, q))


def test_empty_index(spark, chunks):
    path = new_folder(spark, "index")
    inverted.append(chunks.limit(0), path)
    assert inverted.search(path, asked(spark), chunks.limit(0)).count() == 0
