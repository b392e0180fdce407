"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and all but the last return the columns
of documents. `run` applies them to documents; each result is written to the shared folder and read again.

Nulls and edge cases are those of the operators: a document without text is never toxic, loses no line, is like no other
and packs as one token; a null doc_id stays through all stages; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import line_dedup, mixing, ngram_join, packing, toxicity
from quire.llm.common import removed, table, written
from quire.session import ready

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return _documents(toxicity.toxicity(docs, table(spark, sf_dir, "labels")).where("score < 0.5"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in one of them."""
    return _documents(line_dedup.line_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group stays."""
    ready(spark)
    copies = ngram_join.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return _documents(docs.join(copies, "doc_id", "left_anti"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it as a whole; the one that a target cuts counts if half of it is taken."""
    ready(spark)
    mixed = mixing.mix(docs)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    return _documents(mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Workers still hold what earlier stages allocated, so the tokenizer's memory is kept small here."""
    ready(spark)
    return packing.best_fit_packing(docs, remembered=150_000)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix_sources), ("best-fit packing", pack_documents)]

#: Learned scores and a tokenizer's ids are beyond SQL; tests/llm hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), "stage")
        if before:
            removed(spark, before)
        before = path
    return docs
