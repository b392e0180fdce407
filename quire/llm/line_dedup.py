"""Operator 10: drop lines that many documents share.

Lines are exploded as normalised keys, hashed (128 bits) and counted by distinct documents; the lines of frequent keys go,
except in the largest doc_id that holds the key, and the others are reassembled by position.

Nulls and edge cases: a null or empty text is one empty line and stays as it is; rows of one doc_id are one document, however
many texts they have, and each row loses its own lines only; rows with a null doc_id are one document too, which never keeps
a line that a real id holds; extra columns pass through, but n_lines and n_dropped are replaced; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

_TRIM = " \t\n\x0b\x0c\r"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def keys(line):
    return F.translate(F.btrim(line, F.lit(_TRIM)), _UP, _LOW)


def _copy(text):
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines_to_drop(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, salts: int = 16) -> DataFrame:
    """(doc_id, copy, gone array<int>): the positions, from 0, of lines that go; copy is a hash of the row's text.

    A key in a third of all documents is one row of the aggregate, since it is counted before the shuffle; its row is
    then copied to every salt, so that its lines are joined by many tasks.
    """
    t = F.col("text")
    lines = docs.select("doc_id", _copy(t).alias("copy"), F.posexplode(F.split(F.coalesce(t, F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.select("doc_id", "copy", "pos", keys("line").alias("key")).where(F.length("key") >= min_chars)
    lines = lines.select("doc_id", F.struct("copy", "pos").alias("at"), F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    once = lines.groupBy("doc_id", "h1", "h2").agg(F.collect_list("at").alias("at"))
    once = once.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    once = cut(once)
    often = once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    often = often.select("h1", "h2", "keeper", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    gone = once.join(often, ["h1", "h2", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = gone.select("doc_id", F.explode("at").alias("at"))
    return gone.groupBy("doc_id", F.col("at.copy").alias("copy")).agg(F.collect_list("at.pos").alias("gone"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with the text that is left and n_lines, n_dropped."""
    gone = lines_to_drop(docs, min_chars, min_docs).select(*[F.col(c).alias(f"_line_dedup_{c}") for c in ("doc_id", "copy", "gone")])
    same = docs["doc_id"].eqNullSafe(gone["_line_dedup_doc_id"]) & (_copy(docs["text"]) == gone["_line_dedup_copy"])
    joined = docs.join(gone, same, "left")
    none, gone = F.expr("CAST(array() AS array<int>)"), F.col("_line_dedup_gone")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(gone, none))
    kept = F.transform(F.array(lines), lambda x: F.array_join(F.transform(places, lambda i: F.get(x, i)), "\n"))[0]  # lines are split once
    extra = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *[F.when(gone.isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in extra],
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(places)).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone FROM k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
