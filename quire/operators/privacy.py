"""Reversible redaction: patterns in order of priority on text that earlier ones have masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three patterns, highest priority first. A name is taken as a whole run, so that a run without @ is read once.
PATTERNS = {"mobile": r"1[3-9]\d{9}", "id_number": r"\d{17}[\dXx]", "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}


def _label(name: str, i: Column) -> Column:
    """Numbered on from what is redacted already."""
    return F.concat(F.lit(f"⟦{name}_"), (F.size("redactions") + i + 1).cast("string"), F.lit("⟧"))


def _mask(text: Column, pattern: str, name: str) -> Column:
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i < F.size(hits), _label(name, i)).otherwise(F.lit("")))), "")


def redact(docs: DataFrame, patterns: dict[str, str] = PATTERNS, when: Column | None = None) -> DataFrame:
    """docs with redacted and redactions (array of placeholder, original). `when` is false: text stays."""
    on = F.lit(True) if when is None else when
    d = docs.withColumn("redacted", F.coalesce("text", F.lit(""))).withColumn("redactions", F.expr("CAST(array() AS array<struct<placeholder:string,original:string>>)"))
    for name, pattern in patterns.items():
        hits = F.regexp_extract_all("redacted", F.lit(pattern), F.lit(0))
        new = F.zip_with(hits, F.transform(hits, lambda _, i: i), lambda h, i: F.struct(_label(name, i).alias("placeholder"), h.alias("original")))  # noqa: B023
        some = on & F.regexp_like("redacted", F.lit(pattern))
        masked = F.when(some, _mask(F.col("redacted"), pattern, name)).otherwise(F.col("redacted"))
        d = d.withColumns({"redacted": masked, "redactions": F.when(some, F.concat("redactions", new)).otherwise(F.col("redactions"))})
    return d


def redaction_map(redacted: DataFrame) -> DataFrame:
    return redacted.select("doc_id", F.posexplode("redactions").alias("n", "x")).select("doc_id", "n", "x.placeholder", "x.original")


def restore(redacted: DataFrame) -> DataFrame:
    """Adds restored; longer placeholders first, so that _1 never eats the start of _10."""
    in_order = F.array_sort("redactions", lambda a, b: F.length(b["placeholder"]) - F.length(a["placeholder"]))
    return redacted.withColumn("restored", F.aggregate(in_order, F.col("redacted"), lambda t, r: F.replace(t, r["placeholder"], r["original"])))
