"""Operator 6: mix sources to target weights by capped water-filling.

The sizes of all sources are summed; a source's share is its weight's part of the whole, clamped at `epochs` times its own
size, and what is clamped off is shared again by weight until no source is above its limit. A source then takes every
document floor(rate) times and, for the fraction, documents in seeded order up to the target; the document in which the
target falls is taken in part, so that a source's sum is its target rounded.

Nulls and edge cases: a null source is a source of its own, after all others; a null text has size 0 and is taken 0 times;
repeated rows count once each, ties of the seeded order fall back to the text's hash; extra columns pass through, but columns
named as the results (size, source_size, target, whole, taken) are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table

WEIGHTS = (5, 2, 1)
#: Documents of one source are drawn in ranges of the seeded order: this many, or one for so many documents.
RANGES, IN_RANGE = 4096, 20_000
#: Sources that may be broadcast.
MOST_BROADCAST = 100_000
RESULTS = ("size", "source_size", "target", "whole", "taken")


def sized(docs: DataFrame) -> DataFrame:
    """Counts words on Arrow's buffers, without leaving a copy of the text."""
    import numpy as np

    from .common import _SPACES, slices

    names = docs.columns

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                text = part.column("text").fill_null("")
                offs = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
                b = np.frombuffer(text.buffers()[2], np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.zeros(0, np.uint8)
                offs = offs - offs[0]
                inside = ~_SPACES[b]
                start = inside.copy()
                start[1:] &= ~inside[:-1]
                edge = offs[:-1][offs[:-1] < len(b)]
                start[edge] = inside[edge]
                total = np.concatenate(([0], np.cumsum(start)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total[offs[1:]] - total[offs[:-1]], pa.int64())], [*part.schema.names, "_mix_size"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(count, f"{fields}, _mix_size long").select(*names, "_mix_size")


def targets(sources: DataFrame, weights=WEIGHTS, epochs: int = 3) -> DataFrame:
    """One row for each source: source_size, target. `sources`: source, source_size."""
    # ranks by code point: within ranges of sources, then from the sizes of the ranges before
    ordered = sources.withColumns({"_null": F.col("source").isNull(), "_key": F.encode(F.coalesce("source", F.lit("")), "UTF-8")})
    ordered = cut(ordered.repartitionByRange("_null", "_key").withColumn("_part", F.spark_partition_id()))
    before = ordered.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_null", "_key")) - 1 + F.col("_before")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int"))
    sources = ordered.join(before, "_part").withColumn("weight", w).withColumn("cap", F.col("source_size") * epochs)
    sources = cut(sources.select("source", "source_size", "weight", "cap"))
    level, fixed = None, (-1, 0)
    while True:
        clamped = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * F.lit(level)
        row = sources.agg(F.sum("source_size"), F.sum("weight"), F.sum(F.when(clamped, F.col("cap"))), F.sum(F.when(clamped, F.col("weight"))), F.count(F.when(clamped, 1))).first()
        if row[0] is None:
            return sources.select("source", "source_size", F.lit(0.0).alias("target"))
        if row[4] == fixed[0] or row[1] == (row[3] or 0):
            break
        fixed = (row[4], 0)
        level = (row[0] - (row[2] or 0)) / (row[1] - (row[3] or 0))
    share = F.col("weight") * F.lit(float(level))
    return sources.select("source", "source_size", F.when(F.col("cap") <= share, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = 3, seed: int = 1) -> DataFrame:
    """docs with size, source_size, target, whole (whole repetitions) and taken (words taken, repeats counted)."""
    docs = docs.drop(*RESULTS)
    ranges = max(RANGES, docs.count() // IN_RANGE)
    d = sized(docs).withColumnRenamed("_mix_size", "size")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")), F.lit(1 << 52))
    d = d.withColumn("_mix_draw", draw).withColumn("_mix_range", (F.col("_mix_draw") / (1 << 52) * ranges).cast("int"))
    small = cut(d.groupBy("source", "_mix_range").agg(F.sum("size").alias("_mix_size")))
    t = targets(small.groupBy("source").agg(F.sum("_mix_size").alias("source_size")), weights, epochs)
    t = t.withColumn("_mix_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("_mix_rest", F.round("target").cast("long") - F.col("_mix_whole") * F.col("source_size"))
    t = cut(t)
    few = F.broadcast if t.count() <= MOST_BROADCAST else lambda x: x
    same = F.col("_mix_source").eqNullSafe(F.col("source"))
    before = F.sum("_mix_size").over(Window.partitionBy("source").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1))
    spans = small.withColumn("_mix_from", F.coalesce(before, F.lit(0))).join(few(t.withColumnRenamed("source", "_mix_source")), same)
    # the range in which the target falls; ranges before it are taken, ranges after it are not
    spans = spans.where((F.col("_mix_from") < F.col("_mix_rest")) & (F.col("_mix_from") + F.col("_mix_size") >= F.col("_mix_rest")))
    spans = t.withColumnRenamed("source", "_mix_source").join(spans.select(F.col("source").alias("_mix_s"), F.col("_mix_range").alias("_mix_cut"), "_mix_from"), F.col("_mix_s").eqNullSafe(F.col("_mix_source")), "left").drop("_mix_s")
    d = d.join(few(spans), same, "left").drop("_mix_source")
    inside = d.where(F.col("_mix_range") == F.col("_mix_cut"))
    order = Window.partitionBy("source").orderBy("_mix_draw", "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_mix_at", F.col("_mix_from") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_mix_rest") - F.col("_mix_at")))
    outside = d.where(~F.col("_mix_range").eqNullSafe(F.col("_mix_cut"))).withColumn("_mix_at", F.lit(None).cast("long"))
    part = F.when(F.col("_mix_at").isNotNull(), part).when(F.col("_mix_range") < F.col("_mix_cut"), F.col("size")).otherwise(F.lit(0))
    d = inside.unionByName(outside).withColumn("_mix_part", part.cast("long"))
    whole = F.col("_mix_whole") + (F.col("_mix_part") >= F.col("size")).cast("long")
    return d.withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(0)).withColumn("taken", F.col("_mix_whole") * F.col("size") + F.col("_mix_part")).drop("_mix_draw", "_mix_range", "_mix_cut", "_mix_from", "_mix_at", "_mix_part", "_mix_rest", "_mix_whole")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return d.select("doc_id", "size", "source_size", "target", "taken")
