"""Every registered record query against its SQL at the smallest size."""

import pytest

import __spark_entry__ as entry
from quire.plans import registry

from .conftest import SF
from .harness import connect, difference


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sql, name):
    assert difference(spark, SF, registry.QUERIES[name], registry.SQL[name], sql) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows_only(spark, name):
    """At sf0.01: the smallest documents hold no key: value line."""
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partitions_do_not_matter(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for name in ("f5_merge_longest", "g1_carry_forward", "b4_pack_chunks", "r6_top_k"):
        one = sorted(map(tuple, registry.QUERIES[name](spark, SF).collect()), key=repr)
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        again = sorted(map(tuple, registry.QUERIES[name](spark, SF).collect()), key=repr)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert one == again


@pytest.mark.parametrize("name", ["b1_paragraph_cap", "b2_slice_sizes"])
def test_empty_texts(spark, tmp_path, name):
    """Empty, missing, short and long texts have the sizes of the SQL."""
    texts = ["", None, " ", "x", "é" * 3000, "x" * 200_000, "\U0001f468\u200d\U0001f469" * 900]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert difference(spark, str(tmp_path), registry.QUERIES[name], registry.SQL[name]) == ""
