"""Audits, routing, estimates and run metrics over task, record and log tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import blank_free, is_blank

#: Bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
# Text of one byte by suffix (others: 1), the suffixes of the input kinds, track and stage names.
TEXT_WEIGHT = {"xlsx": 3, "xls": 3, "docx": 3, "doc": 3, "pdf": 2}
TABULAR = ("xlsx", "xls", "xlsm", "csv", "ods")
TEXT = ("txt",)
OFFICE = ("docx", "doc", "pdf", "pptx", "ppt", "html", "htm", "epub")
MODEL_DISABLED, PARALLEL_TABLES, SEMANTIC, CHARACTERS = "model_disabled", "word_multi_parallel", "semantic_slicing_stack", "char_slice_or_direct"


def cell_audit(raw: DataFrame, final: DataFrame, columns: list[str], key: str = "record_idx") -> DataFrame:
    """key, field, raw, final, status: kept, changed, filled or empty for every cell."""
    long = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("field"), blank_free(k).alias(name)) for k in columns])).alias("x")).select(key, "x.*")
    both = long(raw, "raw").join(long(final, "final"), [key, "field"])
    status = F.when(F.col("final") == "", "empty").when(F.col("raw") == "", "filled").when(F.col("raw") == F.col("final"), "kept").otherwise("changed")
    return both.withColumn("status", status)


def fill_rates(records: DataFrame, columns: list[str]) -> DataFrame:
    """field, n, fill_rate, with a total row."""
    long = records.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), (blank_free(k) != "").cast("int").alias("full")) for k in columns])).alias("x")).select("x.*")
    return long.rollup("field").agg(F.count("*").alias("n"), F.avg("full").alias("fill_rate"))


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Expected keys that no record has."""
    return expected.select(key).distinct().join(found.select(key), key, "left_anti")


def call_stats(log: DataFrame, model: str, ok: Column, seconds: str) -> DataFrame:
    """model, calls, successes, failures, mean_seconds, and a total row (model null)."""
    return log.rollup(model).agg(F.count("*").alias("calls"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.avg(seconds).alias("mean_seconds"))


def latency_histogram(log: DataFrame, seconds: str, by: str, bounds=LATENCY_BOUNDS) -> DataFrame:
    """by, bound, n: calls of at most each bound; one pass, no join."""
    a = log.groupBy(by).agg(*[F.count_if(F.col(seconds) <= b).alias(f"_{i}") for i, b in enumerate(bounds)])
    return a.select(by, F.explode(F.array(*[F.struct(F.lit(b).alias("bound"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)])).alias("x")).select(by, "x.*")


def complexity(files: DataFrame, task: str, size: str, suffix: str) -> DataFrame:
    """task, chunks (of 3,000 characters), seconds, level: low up to 10 chunks, medium up to 30, else high."""
    w = F.lit(1)
    for k, v in TEXT_WEIGHT.items():
        w = F.when(F.lower(suffix) == k, v).otherwise(w)
    chunks = F.greatest(F.lit(1), F.floor(F.sum(F.col(size) * w) / 3000)).cast("long")
    a = files.groupBy(task).agg(chunks.alias("chunks")).withColumn("seconds", 2 + 3 * F.col("chunks"))
    return a.withColumn("level", F.when(F.col("chunks") <= 10, "low").when(F.col("chunks") <= 30, "medium").otherwise("high"))


def timeout(given: Column, seconds: Column, default: int) -> Column:
    """The caller's timeout; where that is the default, 1.5 times the estimate and 10 more, from 30 to 300."""
    return F.when(given == default, F.least(F.lit(300), F.greatest(F.lit(30), F.floor(1.5 * seconds) + 10))).otherwise(given).cast("long")


def runtime(log: DataFrame, task: str, inference: Column, retry: Column, limit: float) -> DataFrame:
    a = log.groupBy(task).agg(F.sum(inference).alias("_i"), F.sum(retry).alias("_r"))
    total = F.round(F.coalesce("_i", F.lit(0.0)) + F.coalesce("_r", F.lit(0.0)), 3)
    return a.select(task, total.alias("total_seconds"), (total <= limit).alias("within_limit"))


def route(tasks: DataFrame) -> DataFrame:
    """Adds track and stages to tasks (use_model, multi_table, homogeneous: boolean; n_text_chunks). Target tables that
    differ are filled in parallel; tables with the same columns are extracted as one and split afterwards."""
    names = lambda *x: F.array(*[F.lit(n) for n in x])
    parallel = F.col("multi_table") & ~F.col("homogeneous")
    track = F.when(~F.col("use_model"), MODEL_DISABLED).when(parallel, PARALLEL_TABLES).when(F.col("n_text_chunks") > 0, SEMANTIC).otherwise(CHARACTERS)
    why = F.when(F.col("n_text_chunks") > 0, "auto_heterogeneous_tables").otherwise("auto_no_text_chunks")
    first = F.when(track == PARALLEL_TABLES, F.array(F.lit("parse_inputs"), F.lit("parallel_word_table_llm"), F.concat(F.lit("skip_word_multi_lx_prefill:"), why)))
    first = first.when(track == SEMANTIC, names("parse_inputs", "semantic_chunks", "langextract_or_prompt")).otherwise(names("parse_inputs", "char_slice_or_direct_prompt"))
    last = F.when(F.col("multi_table"), names("process_by_profile", "internal_structured_merge", "write_template")).otherwise(names("process_by_profile", "write_template"))
    return tasks.withColumns({"track": track, "stages": F.array_join(F.when(track == MODEL_DISABLED, names("skip_llm")).otherwise(F.concat(first, last)), ">")})


def input_kind(files: DataFrame, task: str, suffix: str) -> DataFrame:
    """task, suffixes, kind: tabular or text if all suffixes are, office for one office suffix, unknown for none, else mixed."""
    a = files.groupBy(task).agg(F.array_sort(F.collect_set(suffix)).alias("s"))  # as many as there are kinds of files
    only = lambda kinds: F.size(F.array_except("s", F.array(*[F.lit(x) for x in kinds]))) == 0
    kind = F.when(F.size("s") == 0, "unknown").when(only(TABULAR), "tabular").when(only(TEXT), "text").when((F.size("s") == 1) & only(OFFICE), "office").otherwise("mixed")
    return a.select(task, F.array_join("s", ",").alias("suffixes"), kind.alias("kind"))


def result_metadata(records: DataFrame, within: list[str], required: list[str], files: str) -> DataFrame:
    """One row a task: file_count, record_count, retried_count (records with a blank required cell), complete."""
    blank = reduce(or_, (is_blank(k) for k in required))
    a = records.groupBy(*within).agg(F.countDistinct(files).alias("file_count"), F.count("*").alias("record_count"), F.count_if(blank).alias("retried_count"))
    return a.withColumn("complete", F.col("retried_count") == 0)
