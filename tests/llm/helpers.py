"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns with clashing names."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(4000))
LINE = "All Rights reserved by the owners."


def odd_documents(spark):
    texts = [None, "", " \t\n", "one two", "One two", LONG, LONG + " tail", f"{LINE}\nfirst own line\n\n  {LINE.upper()} \nend", f"x\n{LINE}", f"{LINE}\ny", "a b c d e f g", "A B C D E F G", "é È ü z", "same same same same same same"]
    docs = [(i, t, None if i % 5 == 0 else f"s{i % 3}", "en", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars string, n long")


def table_of(spark, name="documents", sf="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
