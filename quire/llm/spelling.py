"""Operator 13: group spelling variants, words that one inserted, deleted or replaced code point makes another word.

The sorted vocabulary is scanned once for each word with the rows of a banded edit matrix (three cells, since more than one
edit is of no interest). A row belongs to a prefix, so rows up to the longest common prefix of two neighbours in the list are
used again, and where all three cells of a row exceed one edit the whole range of words with that prefix is skipped.

The list is dealt to tasks by what one edit leaves alone. Of two near words whose shorter one has m code points, the first or
the last m // 2 are equal. So a word stands in two lists, under its beginning and, reversed, under its end, once as the
shorter and once as the longer word of a pair; a list holds the words of one key, in order, and Spark sorts it. A key with
more than `most` words is split by the same rule on what is left of its words, as often as needed: no task holds more, save
where two or fewer code points are left, which an alphabet bounds. A pair that both of its lists hold counts in the first
one. Lists give each word's number of near words and its best one, never pairs.

A word's form is its near word of largest n (ties: smallest in code-point order) if that is at least `ratio` times the
word's n; following forms to the last gives the root. n grows by `ratio` with each step, so chains are short and end; they are
followed by doubling.

Nulls and edge cases: a null text or word gives nothing; a null doc_id counts as an empty one in the hash; a word in several
rows counts with the sum of its n; the empty word is near all words of one code point; extra columns are left out; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC32, crc32_of, cut, table, written

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one list at most; lists with more are split.
MOST = 20_000
#: Code points above all others.
_LAST = chr(0x10FFFF)


def near(words: list[str], queries: list[int]) -> Iterator[tuple[int, int]]:
    """(q, j) for each q of `queries` and each j with exactly one edit between words[q] and words[j]; words are sorted."""
    count = len(words)
    lcp = [0] * (count + 1)  # of a word and the one before it
    for j in range(1, count):
        a, b = words[j - 1], words[j]
        most, k = min(len(a), len(b)), 0
        while k < most and a[k] == b[k]:
            k += 1
        lcp[j] = k
    longest = max(map(len, words), default=0)
    # row d: edits between a prefix of d code points and the query's first d - 1, d and d + 1 ones
    less, same, more = [9] * (longest + 1), [0] * (longest + 1), [1] * (longest + 1)
    for q in queries:
        query = words[q]
        size, padded = len(query), f"{query}\0\0"
        j = d = 0
        while j < count:
            word = words[j]
            end = len(word)
            while d < end:
                c, s, m = word[d], same[d], more[d]
                x = s + 1
                if d:
                    y = less[d] + (padded[d - 1] != c)
                    if y < x:
                        x = y
                y = s + (padded[d] != c) if d < size else 9
                if m < y:
                    y = m + 1 if m + 1 < y else y
                if x + 1 < y:
                    y = x + 1
                z = m + (padded[d + 1] != c) if d + 1 < size else 9
                if y + 1 < z:
                    z = y + 1
                d += 1
                less[d], same[d], more[d] = x, y, z
                if x > 1 and y > 1 and z > 1:  # skip all words with this prefix
                    j += 1
                    if j < count and lcp[j] >= d:
                        j = bisect_left(words, word[:d] + _LAST, j)
                    break
            else:
                gap = size - end
                if -1 <= gap <= 1 and (same[d] if gap == 0 else more[d] if gap == 1 else less[d]) == 1:
                    yield q, j
                j += 1
            if lcp[j] < d:
                d = lcp[j]


def _first_list(a: str, b: str, path: str, m: int) -> bool:
    """Whether a pair's first list, of those that hold both, is the one at the end of this path."""
    for p in path:
        k = m // 2
        if (p == "f") != (a[:k] == b[:k]):
            return False
        if p == "b":
            a, b = a[::-1], b[::-1]
        a, b, m = a[k:], b[k:], m - k
    return True


def _scan(words: list[str], rests: list[str], counts: list[int], path: str, m0: int) -> dict[int, tuple[int, int, str]]:
    """For each word with near ones in a list: how many, and the largest n and its word."""
    found: dict[int, tuple[int, int, str]] = {}

    def credit(i: int, j: int) -> None:
        have, n, form = found.get(i, (0, -1, ""))
        if counts[j] > n or counts[j] == n and words[j] < form:
            n, form = counts[j], words[j]
        found[i] = have + 1, n, form

    if len(words) < 2:
        return found
    for q, j in near(rests, [i for i, w in enumerate(words) if len(w) == m0]):
        if _first_list(words[q], words[j], path, m0):
            credit(q, j)
            if len(words[j]) > m0:
                credit(j, q)
    return found


def _lists(batches):
    """Sorted rows of a partition, list by list."""
    key, held = None, ([], [], [], None, None)
    for batch in batches:
        cols = (batch.column(c).to_pylist() for c in ("key", "word", "rest", "n", "path", "m0"))
        for k, word, rest, n, path, m0 in zip(*cols, strict=True):
            if k != key:
                if key is not None:
                    yield held
                key, held = k, ([], [], [], path, m0)
            held[0].append(word)
            held[1].append(rest)
            held[2].append(n)
    if key is not None:
        yield held


def _scanned(batches):
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
    out: list[tuple] = []
    for words, rests, counts, path, m0 in _lists(batches):
        out += ((words[i], *x) for i, x in _scan(words, rests, counts, path, m0).items())
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=schema)


def _split(rows: DataFrame) -> DataFrame:
    """Each row in the list of its rest's beginning and in that of its reversed rest's beginning."""
    both = F.explode(F.array(F.struct(F.lit("f").alias("p"), F.col("rest").alias("r")), F.struct(F.lit("b").alias("p"), F.reverse("rest").alias("r"))))
    k = F.expr("m div 2").cast("int")
    rows = rows.withColumn("_o", both).withColumn("_k", k)
    return rows.select("word", "n", "m0", F.concat("path", "_o.p").alias("path"), F.concat("key", F.col("_o.p"), F.substring("_o.r", F.lit(1), F.col("_k"))).alias("key"), F.substring("_o.r", F.col("_k") + 1, F.length("word")).alias("rest"), (F.col("m") - F.col("_k")).alias("m"))


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, form_n, form) for each word of (word, n) with near words; form: the near word of largest n."""
    roles = F.explode(F.filter(F.array(F.length("word"), F.length("word") - 1), lambda m: m >= 0))
    rows = words.select("word", "n", roles.alias("m0")).select("word", "n", "m0", F.lit("").alias("path"), F.concat(F.col("m0").cast("string"), F.lit(":")).alias("key"), F.col("word").alias("rest"), F.col("m0").alias("m"))
    parts = []
    while True:
        rows = _split(rows)
        large = cut(rows.where("m > 2").groupBy("key").count().where(F.col("count") > most).select("key"))
        if large.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(large, "key", "left_anti"))
        rows = cut(rows.join(large, "key", "left_semi"))
    found = None
    for part in parts:
        lists = part.select("key", "word", "rest", "n", "path", "m0").repartition("key").sortWithinPartitions("key", "rest")
        part = lists.mapInArrow(_scanned, "word string, n_near long, form_n long, form string")
        found = part if found is None else found.union(part)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", (-F.col("_b.less")).alias("form_n"), F.col("_b.form").alias("form"))


def roots(forms: DataFrame, most_links: int) -> DataFrame:
    """(word, root) from (word, form), form never null: chains of up to `most_links` forms followed to the last one."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(2, most_links)))):
        at = cut(at)
        further = at.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        at = at.join(further, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"))
    return at


def spelling_variants(words: DataFrame, ratio: float = 2, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of (word, n)."""
    if ratio <= 1:
        raise ValueError("ratio must exceed 1, so that chains of forms end")
    words, _ = written(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
    span = words.where("n > 0").agg(F.max("n") / F.min("n")).first()[0] or 1
    found, _ = written(near_words(words, most), "near")
    found = words.join(found, "word", "left").withColumn("_true", F.col("form_n") >= ratio * F.col("n"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.expr("if(_true, form, null)").alias("form"), F.expr("if(_true, form_n, null)").alias("form_n"))
    last = roots(found.where("form IS NOT NULL"), 1 + int(math.log(span, ratio)))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(docs: DataFrame, least_chars: int = 5, least: int = 3, damage: int = 97) -> DataFrame:
    """(word, n): maximal runs of letters, A-Z lower-cased; where `damage` divides the crc32 h of `<doc_id>:<run>`, the code
    point h % length is deleted, a typing error that the groups must find (0: none). Shorter runs can't give words."""
    t = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.expr(f"regexp_extract_all(text, '[A-Za-z\\u00C0-\\u00FF]{{{least_chars},}}', 0)")).alias("run"))
    t = t.select("d", F.translate("run", _UP, _LOW).alias("word"))
    if damage:
        t = t.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "word")))
        gone = F.expr("concat(substring(word, 1, cast(h % length(word) as int)), substring(word, cast(h % length(word) as int) + 2))")
        t = t.select(F.when(F.col("h") % damage == 0, gone).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_chars)
    return t.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


SQL = f"""
WITH RECURSIVE {CRC32}
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[a-zA-Z\\x{{C0}}-\\x{{FF}}]{{5,}}')) AS run FROM documents),
hashed AS (SELECT run, {crc32_of("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, remainders),
words AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, count(*) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND n >= 3),
cuts AS (SELECT word, n, p, CASE WHEN p < 0 THEN word ELSE word[:p] || word[p + 2:] END AS left_over FROM (SELECT word, n, unnest(range(-1, length(word))) AS p FROM words)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.left_over = b.left_over
         WHERE a.word <> b.word AND (a.p = b.p OR (a.p = -1) <> (b.p = -1))),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS form_n, min(other ORDER BY other_n DESC, encode(other)) AS x FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
named AS (SELECT f.*, (SELECT min(encode(other)) FROM near WHERE near.word = f.word AND near.other_n = f.form_n) AS form FROM forms f),
chain AS (SELECT word, word AS form, 0 AS step FROM words
          UNION ALL SELECT c.word, decode(f.form), c.step + 1 FROM chain c JOIN named f ON f.word = c.form WHERE f.form IS NOT NULL)
SELECT n.word, decode(n.form) AS form, (SELECT arg_max(form, step) FROM chain WHERE chain.word = n.word) AS root, n.n, n.n_near, n.form_n FROM named n
"""
