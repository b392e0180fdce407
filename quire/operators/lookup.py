"""Look-ups in texts: where values occur, and which document an offset of a joined text belongs to.

Nulls and edge cases: a null text is empty and holds nothing; null and empty values occur nowhere; equal values and equal
offsets keep their rows; an offset outside of all ranges finds nothing; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Values of one automaton, and the code points in them; more values take further passes over the texts.
MOST_VALUES, MOST_CHARS = 200_000, 8_000_000
#: Width of a bin of offsets. Ranges are two or more wide, so a bin meets at most half as many of them.
WIDTH = 4_096


def running(df: DataFrame, within: list[str], order: list[str], size: str) -> DataFrame:
    """df with lo and hi: the sums of `size` before and up to a row, in its group, ordered by `order`. Rows are dealt by ranges
    of the order and summed in each; a window over one row for each range adds what stands before, so that no task holds a
    group, however large."""
    by = [*within, *order]
    d = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    d = cut(d)  # which rows a partition holds is settled here
    inside = Window.partitionBy("_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("hi", F.sum(size).over(inside))
    parts = d.groupBy("_part", *within).agg(F.sum(size).alias("_all"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts.select("_part", *[F.col(k).alias(f"_{k}") for k in within], F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before")))
    same = d["_part"] == parts["_part"]
    for k in within:
        same = same & d[k].eqNullSafe(parts[f"_{k}"])
    d = d.join(parts, same).withColumn("hi", F.col("hi") + F.col("_before"))
    return d.withColumn("lo", F.col("hi") - F.col(size)).select(*df.columns, "lo", "hi")


def ranges(docs: DataFrame, within: list[str], order: str, gap: int = 2) -> DataFrame:
    """docs without text, with lo and hi: the document's character range in the labelled concatenation of its task."""
    sizes = docs.withColumn("_n", F.length(F.coalesce("text", F.lit(""))).cast("long") + gap).drop("text", "lo", "hi")  # texts aren't sorted along
    return running(sizes, within, [order], "_n").drop("_n")


def located(offsets: DataFrame, ranges: DataFrame, within: list[str], at: str = "at", width: int = WIDTH) -> DataFrame:
    """offsets with the other columns of the range [lo, hi) that holds each, an interval join by bins: a range stands in each bin
    that it meets, an offset in its own. Each different offset is looked up once, so that a bin that many ask for is no more
    work than any other; its rows are joined by offset afterwards."""
    bins = F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}")))
    others = [c for c in ranges.columns if c not in within and c not in ("lo", "hi")]
    r = ranges.where("hi > lo").select(*within, *others, "lo", "hi", bins.alias("_bin"))
    o = offsets.select(*within, at).where(F.col(at) >= 0).distinct().withColumn("_bin", F.expr(f"`{at}` div {width}"))
    found = o.join(r, [*within, "_bin"]).where((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).select(*within, at, *others)
    return offsets.join(found, [*within, at])


def _automata(values: DataFrame, value: str) -> Iterator[list[str]]:
    """Different values in blocks of a bounded size, one block at a time on the driver."""
    block, chars = [], 0
    for r in values.select(F.col(value).alias("v")).where("v <> ''").distinct().toLocalIterator(prefetchPartitions=False):
        block.append(r.v)
        chars += len(r.v)
        if len(block) >= MOST_VALUES or chars >= MOST_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def occurrences(docs: DataFrame, values: DataFrame, value: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, value, position (from 1), n: every value that a document's text holds, where it occurs first, and how often,
    overlapping places included. An automaton of all values passes over each text once; it is built from a block of values that
    every task is sent, and values beyond a block take another pass."""
    spark, found = docs.sparkSession, None
    kind = dict(docs.dtypes)[key]
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col(text) != "")
    schema = f"_key {kind}, _value string, position int, n long"
    for block in _automata(values, value):
        sent = spark.sparkContext.broadcast(block)  # at most MOST_CHARS code points

        def search(batches, sent=sent):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, v in enumerate(sent.value):
                automaton.add_word(v, (i, len(v)))
            automaton.make_automaton()
            for batch in batches:
                keys, values, at, n = [], [], [], []
                for row, t in enumerate(batch.column("_text")):
                    first: dict[int, list[int]] = {}
                    for end, (i, size) in automaton.iter(t.as_py()):
                        first.setdefault(i, [end - size + 2, 0])[1] += 1
                    keys += [row] * len(first)
                    values += [sent.value[i] for i in first]
                    at += [x[0] for x in first.values()]
                    n += [x[1] for x in first.values()]
                yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(keys, pa.int64())), pa.array(values, pa.string()), pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["_key", "_value", "position", "n"])

        part = texts.mapInArrow(search, schema)
        found = part if found is None else found.union(part)
    found = spark.createDataFrame([], schema) if found is None else found
    return found.select(F.col("_key").alias(key), F.col("_value").alias(value), "position", "n")


def evidence(docs: DataFrame, values: DataFrame, value: str, text: str = "text", key: str = "doc_id", before: int = 250, length: int = 540) -> DataFrame:
    """values with the first document (smallest key) that holds each and a snippet of it; values that none holds go. Only found
    documents' texts are read again."""
    first = cut(occurrences(docs, values, value, text, key).groupBy(value).agg(F.min(F.struct(key, "position")).alias("_f")).select(value, f"_f.{key}", "_f.position"))
    snippet = F.substr(F.col(text), F.greatest(F.lit(1), F.col("position") - before), F.lit(length))
    shown = first.join(docs.select(key, text), key).select(value, key, "position", snippet.alias("snippet"))
    return values.join(shown, value)
