"""Queries over the intake of files, reuse of results and functions in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql as functions
from ..operators import infer as K
from ..operators import intake, reuse
from ..session import new_folder
from ..sources.inputs import table
from .intake import SQL as INTAKE_SQL

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: First bytes that pages are given by page_id % 8, in hexadecimal digits, with their kinds; suffixes by page_id % 5.
HEADS = [("", None), ("255044462D312E37", "pdf"), ("89504E470D0A1A0A", "image"), ("D0CF11E0A1B11AE1", "ole"), ("7B5C72746631", "rtf"), ("00", "binary_unknown"), ("504B0304" + "78" * 26 + "776F72642F", "zip"), ("504B0304" + "78" * 26 + "6F746865722F", "zip")]
SUFFIXES = [".txt", ".html", ".pdf", "", ".docx"]
_KIND = f"CASE {' '.join(f'WHEN page_id % 8 = {i} THEN {chr(39)}{k}{chr(39)}' for i, (_, k) in enumerate(HEADS) if k)} WHEN contains(lower(substr(html, 1, 8192)), '<html') OR contains(lower(substr(html, 1, 8192)), '<!doctype html') THEN 'html' ELSE 'text' END"
_DISPATCH = f"""WITH k AS (SELECT page_id, html, page_id % 5 AS s, page_id % 8 = 6 AS doc, {_KIND} AS kind FROM pages),
d AS (SELECT *, CASE s WHEN 0 THEN CASE WHEN kind IN ('text', 'html', 'rtf') THEN 'text_suffix_and_text_signature' ELSE 'text_suffix_but_signature_' || kind END
 WHEN 1 THEN CASE WHEN kind IN ('html', 'text') THEN 'html_suffix_and_text_signature' ELSE 'html_suffix_but_signature_' || kind END
 WHEN 2 THEN CASE WHEN kind = 'pdf' THEN 'pdf_suffix_and_pdf_signature' ELSE 'pdf_suffix_but_signature_' || kind END
 WHEN 4 THEN CASE WHEN kind <> 'zip' THEN 'zip_doc_suffix_but_signature_' || kind WHEN doc THEN 'zip_doc_suffix_and_doc_compatible_zip' ELSE 'zip_container_not_doc_compatible' END
 ELSE CASE WHEN kind IN ('text', 'html', 'rtf', 'pdf', 'ole', 'image') THEN 'unknown_suffix_signature_' || kind WHEN kind = 'zip' AND doc THEN 'unknown_suffix_signature_doc_compatible_zip' ELSE 'no_parser_for_signature_' || kind END END AS reason FROM k),
p AS (SELECT *, CASE WHEN reason LIKE 'no_parser%' OR reason LIKE '%_but_%' OR reason LIKE '%_not_%' THEN NULL WHEN s = 0 OR reason IN ('unknown_suffix_signature_text', 'unknown_suffix_signature_html', 'unknown_suffix_signature_rtf') THEN 'text' ELSE 'layout' END AS parser FROM d)"""


def files(spark, d):
    """Pages as files of many kinds, named by suffixes that fit or don't."""
    pick = lambda values, n: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("page_id") % n + 1).cast("int"))
    p = table(spark, d, "pages")
    return p.select("page_id", F.concat(F.lit("f"), pick(SUFFIXES, 5)).alias("name"), F.concat(F.unhex(pick([h for h, _ in HEADS], 8)), F.encode("html", "UTF-8")).alias("content"))


@query("a2_dispatch", f"{_DISPATCH} SELECT page_id, kind, parser, reason FROM p")
def a2(spark, d):
    return intake.dispatched(files(spark, d)).select("page_id", "kind", "parser", "reason")


@query("a3_intake", f"{_DISPATCH} SELECT page_id, kind, CASE WHEN parser = 'text' THEN reason ELSE 'skip (' || reason || ')' END AS reason, CASE WHEN parser = 'text' AND page_id % 8 = 0 THEN sha256(html) END AS text FROM p")
def a3(spark, d):
    """Documents and rejects as one table; the text of rejects is null."""
    docs, rejects = intake.intake(files(spark, d))
    docs = docs.select("page_id", "kind", "reason", F.when(F.col("page_id") % 8 == 0, F.sha2(F.col("text").cast("binary"), 256)).alias("text"))
    return docs.unionByName(rejects.select("page_id", "kind", "reason"), allowMissingColumns=True)


@query("a11_reused", """WITH h AS (SELECT count(DISTINCT text) AS n FROM documents WHERE doc_id % 2 = 0), a AS (SELECT count(DISTINCT text) AS n FROM documents)
SELECT doc_id, length(text) AS chars, h.n AS first, a.n - h.n AS second, CAST(0 AS BIGINT) AS third FROM documents, h, a""")
def a11(spark, d):
    """Half of the documents, then all, then all again: each text is computed once."""
    docs, path = table(spark, d, "documents").select("doc_id", "text"), new_folder(spark, "reuse")
    compute = lambda todo: todo.select("key", F.length("text").cast("long").alias("chars"))
    counts = [reuse.reused(x, ["text"], compute, "chars long", path) for x in (docs.where("doc_id % 2 = 0"), docs, docs)]
    n = [F.lit(c).cast("long").alias(name) for (_, c), name in zip(counts, ("first", "second", "third"), strict=True)]
    return counts[-1][0].select("doc_id", "chars", *n)


@query("k6_cached", "SELECT doc_id, true AS same, CAST(0 AS BIGINT) AS computed FROM documents WHERE text <> ''")
def k6(spark, d):
    """Embeddings from the cache equal fresh ones, and a second run computes none."""
    docs, path = table(spark, d, "documents").select("doc_id", "text").where("text <> ''"), new_folder(spark, "reuse")
    for _ in range(2):
        cached, n = reuse.reused(docs, ["text"], K.embed, "embedding array<float>", path)
    fresh = K.embed(docs.select(F.col("doc_id").cast("string").alias("key"), "text")).withColumnRenamed("embedding", "_fresh")
    both = cached.join(fresh, F.col("doc_id").cast("string") == F.col("key"))
    return both.select("doc_id", (F.col("embedding") == F.col("_fresh")).alias("same"), F.lit(n).cast("long").alias("computed"))


@query("k9_functions", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, trim(coalesce(text, '')) = '' AS blank FROM documents")
def k9(spark, d):
    functions.register(spark)
    return spark.sql("SELECT doc_id, cast(size(latin_tokens(text)) AS BIGINT) AS n, is_blank(text) AS blank FROM {docs}", docs=table(spark, d, "documents"))


@query("b7_sql")
def b7_sql(spark, d):
    """Sentence windows as a table function; a test holds them against the operator."""
    functions.register(spark)
    return spark.sql("SELECT doc_id, w.* FROM {docs} AS d, LATERAL sentence_windows(d.text, 500, 80) AS w", docs=table(spark, d, "documents"))


@query("b17_sql", INTAKE_SQL["b17_merged_cells"])
def b17_sql(spark, d):
    functions.register(spark)
    cell = "named_struct('r', {}, 'pos', {}, 'text', cast({} AS string), 'row_span', {}, 'col_span', {})"
    cells = ", ".join(cell.format(*x) for x in ((0, 0, "p_name", 2, 1), (0, 1, "p_brand", 1, 2), (1, 0, "p_size", 1, 1)))
    part = table(spark, d, "part").selectExpr("p_partkey AS table_idx", f"inline(array({cells}))").withColumn("n_cols", F.lit(3))
    return spark.sql("SELECT * FROM expand_spans(TABLE({cells}))", cells=part)
