"""Intake: texts from bytes, retrieval files, classes of documents, payloads as records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

# Suffixes of tables, and of the kinds of files that a parser takes by suffix and content.
TABLE_SUFFIXES = ("xlsx", "xls", "csv")
SUFFIXES = {
    "text": ("txt", "md", "csv", "tsv", "json", "jsonl", "xml", "yaml", "yml", "log", "ini", "cfg", "conf"),
    "zip_doc": ("docx", "xlsx", "xlsm", "pptx", "epub", "odt", "ods", "odp"),
    "ole": ("doc", "xls", "ppt"),
    "pdf": ("pdf",),
    "rtf": ("rtf",),
    "html": ("html", "htm"),
    "image": ("jpg", "jpeg", "png", "bmp", "tiff", "tif"),
}
# What a file of a suffix's kind may hold, and first bytes of kinds in hexadecimal digits, in order.
HOLDS = {"text": ("text", "html", "rtf"), "zip_doc": ("zip",), "ole": ("ole",), "pdf": ("pdf",), "rtf": ("rtf",), "html": ("html", "text"), "image": ("image",)}
MAGIC = [("255044462D", "pdf"), ("D0CF11E0A1B11AE1", "ole"), ("7B5C727466", "rtf"), ("89504E470D0A1A0A", "image"), ("FFD8FF", "image"), ("424D", "image"), ("49492A00", "image"), ("4D4D002A", "image"), ("504B0304", "zip"), ("504B0506", "zip")]
#: Bytes that tell a kind, and the share of printable ones that makes a text.
HEAD, TEXT_SHARE = 8192, 0.7


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, size, text of the files of a folder, at any depth, by Spark's readers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return decoded(files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content"), "content")


def kind(content: Column | str) -> Column:
    """pdf, ole, rtf, image, zip, html, text or binary_unknown by the first bytes, never by a name. Text has no zero byte and
    enough printable ones; an empty file is text."""
    content = F.col(content) if isinstance(content, str) else content
    head = F.substring(content, 1, HEAD)
    latin = F.decode(head, "ISO-8859-1")
    start = F.hex(F.encode(F.lower(F.substring(latin, 1, 8)), "ISO-8859-1"))  # letters in either case
    out = None
    for magic, name in MAGIC:
        low = bytes.fromhex(magic).decode("latin-1").lower().encode("latin-1").hex().upper()
        out = F.when(start.startswith(low), name) if out is None else out.when(start.startswith(low), name)
    odd = F.length(F.regexp_replace(latin, r"[\x09\x0A\x0D\x20-\x7E\xA0-\xFF]", ""))
    text = (F.length(latin) == 0) | (~F.contains(latin, F.lit("\0")) & ((F.length(latin) - odd) / F.length(latin) >= TEXT_SHARE))
    low = F.lower(latin)
    return out.when(text & (low.contains("<html") | low.contains("<!doctype html")), "html").when(text, "text").otherwise("binary_unknown")


def document_zip(content: Column | str) -> Column:
    """Whether a zip file's entries are those of an office document: a local header (30 bytes) before such a name."""
    content = F.col(content) if isinstance(content, str) else content
    return F.decode(content, "ISO-8859-1").rlike(r"(?si)PK\x03\x04.{26}(?:\[content_types\]\.xml|word/|xl/|ppt/|meta-inf/|mimetype)")


def dispatched(files: DataFrame, content: str = "content", name: str = "name") -> DataFrame:
    """Adds kind, parser and reason: the content decides and the suffix restricts. parser is text, layout (for libraries that
    read pages and tables) or null, where the file is a reject."""
    f = files.withColumn("kind", kind(content))
    suffix, found, doc = F.regexp_extract(F.lower(F.col(name)), r"\.([a-z0-9]+)$", 1), F.col("kind"), document_zip(content)
    reason, parser = None, None
    for of, suffixes in SUFFIXES.items():
        holds = {"html": "text"}.get(of, of)
        good = found.isin(*HOLDS[of])
        here = suffix.isin(*suffixes)
        if of == "zip_doc":
            why = F.when(~good, F.concat(F.lit("zip_doc_suffix_but_signature_"), found)).when(doc, "zip_doc_suffix_and_doc_compatible_zip").otherwise("zip_container_not_doc_compatible")
            takes = F.when(good & doc, "layout")
        else:
            why = F.when(good, f"{of}_suffix_and_{holds}_signature").otherwise(F.concat(F.lit(f"{of}_suffix_but_signature_"), found))
            takes = F.when(good, "text" if of == "text" else "layout")
        reason = F.when(here, why) if reason is None else reason.when(here, why)
        parser = F.when(here, takes) if parser is None else parser.when(here, takes)
    plain = found.isin("text", "html", "rtf", "pdf", "ole", "image")
    reason = reason.when(plain, F.concat(F.lit("unknown_suffix_signature_"), found)).when((found == "zip") & doc, "unknown_suffix_signature_doc_compatible_zip").otherwise(F.concat(F.lit("no_parser_for_signature_"), found))
    parser = parser.when(found.isin("text", "html", "rtf"), "text").when(plain | ((found == "zip") & doc), "layout")
    return f.withColumn("parser", parser).withColumn("reason", reason)


def intake(files: DataFrame, parsers: dict | None = None, content: str = "content", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of files, each file in one of them. documents: the other columns, kind, parser, reason, text. rejects:
    the other columns, kind and reason: `skip (<reason>)` without a parser, `parse_error (<what>)` where one raises. parsers
    maps a parser's name to a function of bytes; `text` is built in, and files whose parser isn't given are rejects too."""
    parsers = {"text": text_of} | (parsers or {})
    rest = [f for f in files.schema.fields if f.name not in (content, "kind", "parser", "reason", "text", "_error")]
    d = dispatched(files, content, name).select(*[F.col(f"`{f.name}`") for f in rest], content, "kind", "parser", "reason")
    known = F.col("parser").isin(*parsers)
    shape = [*(f"`{x.name}` {x.dataType.simpleString()}" for x in rest), "kind string", "parser string", "reason string"]
    names = [*(x.name for x in rest), "kind", "parser", "reason"]

    def one(parser, data):
        try:
            return parsers[parser](bytes(data)), None
        except Exception as e:  # a file that can't be parsed is data here
            return None, str(e)[:200]

    def run(frames):
        for f in frames:
            got = [one(p, c) for p, c in zip(f["parser"], f[content], strict=True)]
            f["text"], f["_error"] = [t for t, _ in got], [e for _, e in got]
            yield f[[*names, "text", "_error"]].astype({"text": "object", "_error": "object"})

    parsed = cut(d.where(known).mapInPandas(run, ", ".join([*shape, "text string", "_error string"])))
    skipped = d.where(~F.coalesce(known, F.lit(False))).select(*[F.col(f"`{x.name}`") for x in rest], "kind", F.concat(F.lit("skip ("), "reason", F.lit(")")).alias("reason"))
    failed = parsed.where("_error IS NOT NULL").select(*[F.col(f"`{x.name}`") for x in rest], "kind", F.concat(F.lit("parse_error ("), "_error", F.lit(")")).alias("reason"))
    return parsed.where("_error IS NULL").drop("_error"), skipped.unionByName(failed)


def text_of(data: bytes | None) -> str | None:
    """UTF-8, with or without a mark, else GB18030, else UTF-8 without what can't be read."""
    if data is None:
        return None
    for form in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(form)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="ignore")


def decoded(files: DataFrame, content: str) -> DataFrame:
    """files with text instead of the bytes in `content`."""
    rest = [f for f in files.schema.fields if f.name != content]

    def run(frames):
        for f in frames:
            f["text"] = [text_of(x) for x in f[content]]
            yield f[[*(x.name for x in rest), "text"]]

    return files.mapInPandas(run, ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in rest), "text string"]))


def retrieved(files: DataFrame, column: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(chunks, results) of an upstream retrieval file's JSON: keys, pos, text, type, score; keys, structured_result (map)."""
    schema = "retrieved_chunks array<struct<text:string,type:string,score:double>>, structured_result map<string,string>"
    j = files.select(*keys, F.from_json(column, schema).alias("_j"))
    return j.select(*keys, F.posexplode("_j.retrieved_chunks").alias("pos", "_c")).select(*keys, "pos", "_c.*"), j.select(*keys, "_j.structured_result")


def classify(records: Column | int = 0, frame_rows: Column | int = 0, table_rows: Column | int = 0, suffix: Column | str = "") -> Column:
    """structured for extracted records, then for tables with rows, then for a table's suffix; else unstructured."""
    some = lambda n: F.coalesce(n if isinstance(n, Column) else F.lit(n), F.lit(0)) >= 1
    suffix = suffix if isinstance(suffix, Column) else F.lit(suffix)
    return F.when(some(records) | some(frame_rows) | some(table_rows) | F.lower(suffix).isin(*TABLE_SUFFIXES), "structured").otherwise("unstructured")


def segments(text: Column) -> Column:
    """Whether a text looks like several segments or items: sentences over 200 characters, or numbered lines."""
    return F.coalesce((F.contains(text, F.lit("。")) & (F.length(text) > 200)) | text.rlike(r"(?:^|\n)\s*\d+[.、)]"), F.lit(False))


def record_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 200))


def records_view(payloads: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys, pos, record (map): a payload's records; a flat object without any is one record, its `_` keys left out."""
    j = payloads.select(*keys, F.from_json(F.get_json_object(column, "$.records"), "array<map<string,string>>").alias("_r"), F.from_json(column, "map<string,string>").alias("_o"))
    own = F.map_filter("_o", lambda k, _: ~k.startswith("_") & (k != "records"))
    flat = F.when(F.size(own) > 0, F.array(own)).otherwise(F.array().cast("array<map<string,string>>"))
    return j.select(*keys, F.posexplode(F.when(F.size("_r") > 0, F.col("_r")).otherwise(F.coalesce(flat, F.array().cast("array<map<string,string>>")))).alias("pos", "record"))
