"""Intake of files, reuse of results and SQL functions."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import sql
from quire.operators import chunks, intake, layout, reuse
from quire.session import new_folder


def zipped(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return out.getvalue()


FILES = [
    ("a.txt", b"plain text", "text", "text", "text_suffix_and_text_signature"),
    ("a.md", b"", "text", "text", "text_suffix_and_text_signature"),
    ("a.csv", b"\x89PNG\r\n\x1a\nxx", "image", None, "text_suffix_but_signature_image"),
    ("a.TXT", "é漢".encode() * 9, "text", "text", "text_suffix_and_text_signature"),
    ("b.pdf", b"%PDF-1.7 x", "pdf", "layout", "pdf_suffix_and_pdf_signature"),
    ("b.pdf", b"%pdf-1.7 x", "pdf", "layout", "pdf_suffix_and_pdf_signature"),
    ("b.pdf", b"not one", "text", None, "pdf_suffix_but_signature_text"),
    ("c.docx", zipped("[Content_Types].xml", "word/document.xml"), "zip", "layout", "zip_doc_suffix_and_doc_compatible_zip"),
    ("c.docx", zipped("other/file"), "zip", None, "zip_container_not_doc_compatible"),
    ("c.xlsx", b"text", "text", None, "zip_doc_suffix_but_signature_text"),
    ("d.doc", bytes.fromhex("D0CF11E0A1B11AE1") + b"x", "ole", "layout", "ole_suffix_and_ole_signature"),
    ("e.rtf", b"{\\RTF1 x", "rtf", "layout", "rtf_suffix_and_rtf_signature"),
    ("f.html", b"<HTML><body>", "html", "layout", "html_suffix_and_text_signature"),
    ("f.htm", b"BMxx", "image", None, "html_suffix_but_signature_image"),
    ("g.jpg", b"\xff\xd8\xff\xe0", "image", "layout", "image_suffix_and_image_signature"),
    ("g.tif", b"II*\x00..", "image", "layout", "image_suffix_and_image_signature"),
    ("noname", b"<!doctype html>", "html", "text", "unknown_suffix_signature_html"),
    ("x.bin", b"\x00\x01\x02", "binary_unknown", None, "no_parser_for_signature_binary_unknown"),
    ("x.odd", bytes([128, 129, 130, 131, 65]), "binary_unknown", None, "no_parser_for_signature_binary_unknown"),
    ("x.odd", zipped("ppt/slide"), "zip", "layout", "unknown_suffix_signature_doc_compatible_zip"),
    ("x", zipped("a"), "zip", None, "no_parser_for_signature_zip"),
]


def test_dispatch_and_rejects(spark):
    df = spark.createDataFrame([(i, n, bytearray(c)) for i, (n, c, *_) in enumerate(FILES)], "i int, name string, content binary")
    got = {r.i: (r.kind, r.parser, r.reason) for r in intake.dispatched(df).collect()}
    for i, (_, _, *want) in enumerate(FILES):
        assert got[i] == tuple(want), FILES[i]

    def pages(data):
        if data.startswith(b"%pdf"):
            raise ValueError("no pages")
        return "pages"

    docs, rejects = intake.intake(df, {"layout": pages})
    docs, rejects = {r.i: r for r in docs.collect()}, {r.i: r for r in rejects.collect()}
    assert not docs.keys() & rejects.keys() and len(docs) + len(rejects) == len(FILES)
    assert (docs[0].text, docs[1].text, docs[3].text, docs[4].text) == ("plain text", "", "é漢" * 9, "pages")
    assert rejects[2].reason == "skip (text_suffix_but_signature_image)" and rejects[5].reason == "parse_error (no pages)"
    docs, rejects = intake.intake(df)
    assert {r.parser for r in docs.collect()} == {"text"} and rejects.where("reason LIKE '%pdf_suffix_and%'").count() == 2
    docs, rejects = intake.intake(df.limit(0))
    assert docs.count() == rejects.count() == 0


def test_files_of_a_folder(spark, tmp_path):
    for i, (_, content, *_) in enumerate(FILES[:6]):
        (tmp_path / f"{i}.txt").write_bytes(content)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    docs, rejects = intake.intake(files)
    assert {r.name for r in docs.collect()} == {"0.txt", "3.txt"}  # Spark's readers leave out empty files
    assert {r.name for r in rejects.collect()} == {"2.txt", "4.txt", "5.txt"}


def test_reuse(spark):
    path, asked = new_folder(spark, "reuse"), spark.sparkContext.accumulator(0)

    def compute(todo):
        def run(frames):
            for f in frames:
                asked.add(len(f))
                f["n"] = [len(t or "") for t in f["text"]]
                yield f[["key", "n"]]

        return todo.mapInPandas(run, "key string, n long")

    rows = [(1, "aa", "x"), (2, "aa", "y"), (3, None, "z"), (4, "", "z")]
    df = spark.createDataFrame(rows, "id int, text string, key string")
    got, n = reuse.reused(df, ["text"], compute, "n long", path)
    assert n == asked.value == 3 and {r.id: r.n for r in got.collect()} == {1: 2, 2: 2, 3: 0, 4: 0}
    more = df.union(spark.createDataFrame([(5, "bbbb", "x"), (6, "aa", "x")], df.schema))
    got, n = reuse.reused(more, ["text"], compute, "n long", path)
    assert n == 1 and asked.value == 4 and {r.id: r.n for r in got.collect()} == {1: 2, 2: 2, 3: 0, 4: 0, 5: 4, 6: 2}
    got, n = reuse.reused(more, ["text"], compute, "n long", path)
    assert n == 0 and asked.value == 4 and got.count() == 6

    def broken(todo):
        return todo.select("key", F.raise_error(F.lit("down")).cast("long").alias("n"))

    with pytest.raises(Exception, match="down"):
        reuse.reused(spark.createDataFrame([(7, "new", "x")], df.schema), ["text"], broken, "n long", path)
    got, n = reuse.reused(spark.createDataFrame([(7, "new", "x")], df.schema), ["text"], compute, "n long", path)
    assert n == 1 and got.first().n == 3
    assert reuse.reused(df.limit(0), ["text"], compute, "n long", path)[1] == 0


def test_sql_functions(spark):
    sql.register(spark)
    docs = spark.createDataFrame([(1, "One. Two; three.\n" * 90), (2, None), (3, ""), (4, "short")], "doc_id long, text string")
    docs.createOrReplaceTempView("surface_docs")
    got = spark.sql("SELECT doc_id, w.* FROM surface_docs, LATERAL sentence_windows(surface_docs.text, 200, 20) w")
    want = chunks.sentence_windows(docs, 200, 20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="overlap"):
        spark.sql("SELECT * FROM sentence_windows('x', 10, 9)").collect()
    cells = [(1, 0, 0, "a", 2, 1, 3), (1, 0, 1, "b", 1, 2, 3), (1, 1, 0, "c", 1, 1, 3), (2, 0, 0, "d", 1, 9, 2), (2, 0, 1, "e", 1, 1, 2)]
    cells = spark.createDataFrame(cells, "table_idx long, r int, pos int, text string, row_span int, col_span int, n_cols int")
    cells.createOrReplaceTempView("surface_cells")
    want = sorted(map(tuple, layout.expand_spans(cells).collect()))
    assert sorted(map(tuple, spark.sql("SELECT * FROM expand_spans(TABLE(surface_cells))").collect())) == want
    spark.sql("SELECT table_idx AS name, r, pos, text, row_span, col_span, n_cols FROM surface_cells").createOrReplaceTempView("surface_named")
    assert sorted((r.name, r.r, r.c, r.text) for r in spark.sql("SELECT * FROM expand_spans(TABLE(surface_named), 'name')").collect()) == want
    with pytest.raises(Exception, match="row_span"):
        spark.sql("SELECT * FROM expand_spans(TABLE(surface_docs), 'doc_id')").collect()
    r = spark.sql("SELECT latin_tokens('A b-1 É') AS t, is_blank(' ') AS b, type_boost('table') AS x, bm25_part(1, 2, 3, 4, 5) AS s").first()
    assert (r.t, r.b, r.x) == (["a", "b", "1"], True, 1.2) and abs(r.s - 2 * 3 * 2.5 / (3 + 1.5 * (0.25 + 0.75 * 4 / 5))) < 1e-12
