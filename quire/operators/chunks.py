"""Documents to chunks: sizes, paragraphs, packing, windows, Markdown tables. One document never leaves its task."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paragraph_cap(n: Column, blank: int | None = 1600) -> Column:
    """Characters that a chunk may hold, by the text's length. blank: for an empty text, which None treats as any other length."""
    cap = F.greatest(F.lit(1200.0), F.least(F.lit(2800.0), 1100 + 2.4 * F.pow(n, F.lit(0.42)))).cast("int")
    return cap if blank is None else F.when(n <= 0, blank).otherwise(cap)


def slice_sizes(n: Column, blank: tuple[int, int, int] | None = (2000, 120, 2200)) -> list[Column]:
    """slice_size, overlap and direct: window, overlap and the length below which a text isn't cut. blank: as in paragraph_cap."""
    size = F.greatest(F.lit(1600.0), F.least(F.lit(4800.0), 1250 + 3.4 * F.pow(n, F.lit(0.38)))).cast("int")
    lap = F.greatest(F.lit(72.0), F.least(F.lit(520.0), size * 0.075)).cast("int")
    direct = F.least(F.lit(5200), F.greatest(F.lit(1600), (800 + n * 0.028).cast("int")))
    sizes = dict(zip(("slice_size", "overlap", "direct"), (size, lap, direct), strict=True))
    return [(x if blank is None else F.when(n <= 0, empty).otherwise(x)).alias(k) for (k, x), empty in zip(sizes.items(), blank or (None,) * 3, strict=True)]


def paragraphs(text: Column) -> Column:
    """Blank-line separated blocks, their lines trimmed and joined by a space."""
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.array_join(lines(p), " ")), lambda p: p != "")


def pack(parts: Column, cap: Column, joined: str = "\n") -> Column:
    """Greedy packing: a part that would exceed the cap opens a chunk; separators don't count."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("held"), F.lit(0).alias("n"))

    def step(s, p):
        over = (s["n"] + F.length(p) > cap) & (F.size(s["held"]) > 0)
        return F.struct(
            F.when(over, F.array_append(s["done"], F.array_join(s["held"], joined))).otherwise(s["done"]).alias("done"),
            F.when(over, F.array(p)).otherwise(F.array_append(s["held"], p)).alias("held"),
            F.when(over, F.length(p)).otherwise(s["n"] + F.length(p)).alias("n"),
        )

    return F.aggregate(parts, start, step, lambda s: F.when(F.size(s["held"]) > 0, F.array_append(s["done"], F.array_join(s["held"], joined))).otherwise(s["done"]))


def packed_chunks(docs: DataFrame, parts: Column | None = None) -> DataFrame:
    """doc_id, chunk_idx, text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = paragraphs(text) if parts is None else parts
    d = docs.select("doc_id", parts.alias("_parts"), paragraph_cap(F.length(text)).alias("_cap"))
    return d.select("doc_id", F.posexplode(pack(F.col("_parts"), F.col("_cap"))).alias("chunk_idx", "text"))


def packed_items(items: DataFrame, cap: int = 1600) -> DataFrame:
    """doc_id, chunk_idx, type, text: text items pack; tables, formulas and code end a chunk and stand alone."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("idx", "type", "line"))), lambda x: F.struct(x["type"].alias("type"), x["line"].alias("line")))
    d = items.groupBy("doc_id").agg(in_order.alias("_items"))
    chunk = "array<struct<type:string,text:string>>"
    start = F.struct(F.array().cast(chunk).alias("done"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("n"))
    one = lambda kind, text: F.struct(kind.alias("type"), text.alias("text"))

    def step(s, x):
        text, kind = x["line"], x["type"]
        flushed = F.when(F.coalesce(F.trim(s["held"]), F.lit("")) != "", F.array_append(s["done"], one(F.lit("text"), F.trim(s["held"])))).otherwise(s["done"])
        over = s["n"] + F.length(text) > cap
        done = F.when(kind != "text", F.array_append(flushed, one(kind, text))).when(over, flushed).otherwise(s["done"])
        held = F.when(kind != "text", F.lit(None)).when(over | s["held"].isNull(), text).otherwise(F.concat(s["held"], F.lit("\n"), text))
        return F.struct(done.alias("done"), held.alias("held"), F.when(kind != "text", 0).when(over, F.length(text)).otherwise(s["n"] + F.length(text)).alias("n"))

    end = lambda s: F.when(F.coalesce(F.trim(s["held"]), F.lit("")) != "", F.array_append(s["done"], one(F.lit("text"), F.trim(s["held"])))).otherwise(s["done"])
    d = d.select("doc_id", F.posexplode(F.aggregate("_items", start, step, end)).alias("chunk_idx", "_c"))
    return d.select("doc_id", "chunk_idx", F.col("_c.type").alias("type"), F.col("_c.text").alias("text"))


def merged_by_type(items: DataFrame, cap: int = 3500, other_cap: int = 1500) -> DataFrame:
    """doc_id, type, chunk_idx, text: small chunks of one type joined by a blank line up to the type's cap."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"])
    d = items.groupBy("doc_id", "type").agg(parts.alias("_parts"))
    limit = F.when(F.col("type") == "text", cap).otherwise(other_cap)
    return d.select("doc_id", "type", F.posexplode(pack(F.col("_parts"), limit, "\n\n")).alias("chunk_idx", "text"))


def windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, start, end, text: fixed windows; the last one ends with the text."""
    n = F.length("text")
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap)).cast("int")))
    d = docs.where(n > 0).select("doc_id", "text", F.explode(F.transform(steps, lambda i: i * (size - overlap))).alias("start"))
    return d.select("doc_id", "start", F.least(n, F.col("start") + size).alias("end"), F.substr("text", F.col("start") + 1, F.lit(size)).alias("text"))


def window_places(text: str, size: int = 500, overlap: int = 80):
    """Start and end of windows that end after the last separator of their second half; the first separator kind that occurs
    there wins."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            places = (text.rfind(s, at + size // 2, end) for s in "。\n；.;")
            end = next((p + 1 for p in places if p >= 0), end)
        yield at, end
        if end == len(text):
            return
        at = end - overlap


def sentence_windows(docs: DataFrame, size: int = 500, overlap: int = 80) -> DataFrame:
    """doc_id, start, end, text. Each start depends on the window before, so texts are walked in Arrow batches."""

    def run(frames):
        for f in frames:
            rows = [(d, a, b, t[a:b]) for d, t in zip(f["doc_id"], f["text"], strict=True) if t for a, b in window_places(t, size, overlap)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, start int, end int, text string")


def batches(chunks: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Adds batch: every k chunks of a task, in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return chunks.withColumn("batch", F.floor((F.row_number().over(w) - 1) / k))


def first_chunks(chunks: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k chunks of a task that are no tables."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return chunks.where("type <> 'table'").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def context(chunks: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """keys, context: non-blank texts joined by blank lines and cut at `most` characters."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim("text").alias("t")))), lambda x: x["t"])
    return chunks.where(F.trim("text") != "").groupBy(*keys).agg(F.substring(F.array_join(parts, "\n\n"), 1, most).alias("context"))


def markdown_rows(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """doc_id, row_idx, row (map): rows of a Markdown table; separator lines and blank outer cells removed."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x.contains("|"))
    cells = lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda v: F.trim(v)), lambda v: v != "")
    d = docs.select("doc_id", lines.alias("_l")).where(F.size("_l") > 0)
    d = d.select("doc_id", cells(F.col("_l")[0]).alias("_h"), F.filter(F.slice("_l", 2, F.size("_l")), lambda x: ~x.rlike(r"^[|\-: ]*$")).alias("_d"))
    d = d.select("doc_id", "_h", F.posexplode("_d").alias("row_idx", "_line")).withColumn("_c", cells(F.col("_line")))
    values = F.transform("_h", lambda h, i: F.coalesce(F.get("_c", i), F.lit("")))
    return d.select("doc_id", "row_idx", F.map_from_arrays("_h", values).alias("row"))


def to_markdown(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """keys, markdown."""
    cell = lambda x: F.replace(F.replace(F.coalesce(F.col(x).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(x) for x in columns]), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    head = f"| {' | '.join(columns)} |\n| {' | '.join(['---'] * len(columns))} |\n"
    return rows.groupBy(*keys).agg(F.concat(F.lit(head), body).alias("markdown"))
