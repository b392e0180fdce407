"""Queries over retrieval, privacy, conversations, logs, model answers and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import answers
from ..operators import infer as K
from ..operators import inverted
from ..operators import predicates as E
from ..operators import privacy as P
from ..operators import quality as J
from ..operators import retrieval as R
from ..operators import vectors
from ..session import new_folder
from ..sources.inputs import ITEMS, MESSY, items, messy, table
from ..streaming.arrivals import call_windows

QUERIES, SQL = {}, {}
QUESTIONS = ["rights reserved license", "the public version", "idiot clown", "und nicht"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_Q = ", ".join(f"('{q}')" for q in QUESTIONS)
_BM25 = rf"""{ITEMS}, c AS (SELECT doc_id, idx, type, regexp_extract_all(lower(line), '[a-z0-9]+') AS t FROM items WHERE trim(line) <> ''), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM c),
tf AS (SELECT doc_id, idx, len(t) AS dl, token, count(*) AS tf FROM (SELECT doc_id, idx, t, unnest(t) AS token FROM c) GROUP BY doc_id, idx, dl, token, len(t)), df AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, s GROUP BY token), m AS (SELECT avg(idf) AS mean FROM df),
q AS (SELECT question, token, count(*) AS times FROM (SELECT question, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS token FROM (VALUES {_Q}) v(question)) GROUP BY ALL),
b AS (SELECT question, doc_id, idx, sum(times * CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM q JOIN df USING (token) JOIN tf USING (token), m, s GROUP BY question, doc_id, idx)"""


def chunks(spark, d):
    return items(spark, d).where(F.trim("line") != "").withColumnRenamed("line", "text")


def questions(spark):
    return spark.createDataFrame([(q,) for q in QUESTIONS], "question string")


@query("r1_bm25", f"WITH {_BM25} SELECT question, doc_id, idx, round(bm25, 6) AS bm25 FROM b")
def r1(spark, d):
    return R.bm25(chunks(spark, d).drop("type"), questions(spark)).withColumn("bm25", F.round("bm25", 6))


_TOP = f"""{_BM25}, a AS (SELECT v.question, c.doc_id, c.idx, type, coalesce(bm25, 0) AS bm25 FROM c CROSS JOIN (VALUES {_Q}) v(question) LEFT JOIN b ON b.question = v.question AND b.doc_id = c.doc_id AND b.idx = c.idx),
n AS (SELECT *, min(bm25) OVER (PARTITION BY question) AS lo, max(bm25) OVER (PARTITION BY question) AS hi FROM a), f AS (SELECT question, doc_id, idx, type, round(CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (bm25 - lo) / (hi - lo) END * CASE type WHEN 'table' THEN 1.2 WHEN 'formula' THEN 1.1 WHEN 'code' THEN 1.05 ELSE 1 END, 9) AS score FROM n),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id, idx) AS rank FROM f) WHERE rank <= 10)"""


@query("r6_top_k", f"WITH {_TOP} SELECT question, doc_id, idx, type, round(score, 6) AS score, 'bm25' AS method, CAST(rank AS INTEGER) AS rank FROM top")
def r6(spark, d):
    """Search: BM25, min-max, type boost, the ten best chunks of each question."""
    return R.search(chunks(spark, d), questions(spark)).select("question", "doc_id", "idx", "type", F.round("score", 6).alias("score"), "method", "rank")


@query("r6_indexed", f"WITH {_TOP} SELECT question, doc_id, idx, type, round(score, 6) AS score, 'bm25' AS method, CAST(rank AS INTEGER) AS rank FROM top")
def r6_indexed(spark, d):
    """The same search from a stored index of two appends: blocks that can't reach the ten best stay closed."""
    path, c = new_folder(spark, "index"), chunks(spark, d)
    for part in (0, 1):
        inverted.append(c.where(F.col("doc_id") % 2 == part), path)
    return inverted.search(path, questions(spark), c).select("question", "doc_id", "idx", "type", F.round("score", 6).alias("score"), "method", "rank")


@query("r8_source_list", f"WITH {_TOP} SELECT question, CAST(rank AS INTEGER) AS rank, source, substr(trim(line), 1, 200) AS excerpt, round(score, 3) AS score, 'bm25' AS method, top.type FROM top JOIN items USING (doc_id, idx) JOIN documents USING (doc_id)")
def r8(spark, d):
    return R.source_list(R.search(chunks(spark, d), questions(spark)), table(spark, d, "documents").select("doc_id", "source"))


_COS = "list_dot_product(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.embedding, lambda x: CAST(x AS DOUBLE))) / (sqrt(list_dot_product(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)))) * sqrt(list_dot_product(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)))) + 1e-9)"


def embeddings(spark, d):
    """All vectors, and the stated query set."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e, e.where(F.col("vec_id") % 100 == 0)


@query("r2_cosine", f"SELECT q.vec_id AS q_id, e.vec_id, round({_COS}, 4) AS cos FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0")
def r2(spark, d):
    return vectors.cosines(*embeddings(spark, d), digits=4)


@query("r3_min_max", f"SELECT q_id, vec_id, round((cos - min(cos) OVER (PARTITION BY q_id)) / (max(cos) OVER (PARTITION BY q_id) - min(cos) OVER (PARTITION BY q_id)), 4) AS scaled FROM (SELECT q.vec_id AS q_id, e.vec_id, {_COS} AS cos FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)")
def r3(spark, d):
    return vectors.cosines(*embeddings(spark, d), digits=4, scaled=True).withColumnRenamed("cos", "scaled")


#: Questions with the vector that asks with them; the last two have one signal only.
HYBRID = [*[(q, 100 * i) for i, q in enumerate(QUESTIONS)], ("qqzzqq", 400), ("the of and", None)]
_HYBRID = ", ".join(f"('{q}', {'NULL' if v is None else v})" for q, v in HYBRID)
_BM25_DOCS = "c AS (SELECT doc_id, 0 AS idx, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), " + _BM25[_BM25.index("s AS (SELECT count(*)") :].replace(_Q, ", ".join(f"('{q}')" for q, _ in HYBRID))


@query("r4_fuse", f"""WITH {_BM25_DOCS}, texts AS (SELECT question, doc_id, bm25 / max(bm25) OVER (PARTITION BY question) AS bm25 FROM b),
vecs AS (SELECT question, vec_id AS doc_id, (cos - min(cos) OVER w) / (max(cos) OVER w - min(cos) OVER w) AS cos FROM (SELECT h.question, e.vec_id, {_COS} AS cos FROM (VALUES {_HYBRID}) h(question, v) JOIN embeddings q ON q.vec_id = h.v CROSS JOIN embeddings e) WINDOW w AS (PARTITION BY question))
SELECT question, doc_id, round(CASE WHEN vs.question IS NULL THEN bm25 WHEN ts.question IS NULL THEN cos ELSE 0.65 * coalesce(cos, 0) + 0.35 * coalesce(bm25, 0) END, 4) AS score,
 CASE WHEN vs.question IS NULL THEN 'bm25' WHEN ts.question IS NULL THEN 'vector' ELSE 'hybrid(vector+bm25)' END AS method
FROM vecs FULL JOIN texts USING (question, doc_id) LEFT JOIN (SELECT DISTINCT question FROM vecs) vs USING (question) LEFT JOIN (SELECT DISTINCT question FROM texts) ts USING (question)""")  # fmt: skip
def r4(spark, d):
    """Documents by BM25 and by their vectors, fused: some have one signal, and so have two of the questions."""
    docs = table(spark, d, "documents").select("doc_id", F.lit(0).alias("idx"), "text")
    asked = spark.createDataFrame(HYBRID, "question string, v long")
    texts = R.bm25(docs, asked.select("question"))
    texts = texts.join(texts.groupBy("question").agg(F.max("bm25").alias("_hi")), "question").withColumn("bm25", F.col("bm25") / F.col("_hi"))
    e = vectors.unit(table(spark, d, "embeddings")).select(F.col("vec_id").alias("doc_id"), "unit")
    q = F.broadcast(asked.join(e.select(F.col("doc_id").alias("v"), F.col("unit").alias("q")), "v").select("question", "q"))  # a row for each question
    near = R.min_max(e.crossJoin(q).select("question", "doc_id", R.dot("unit", "q").alias("_cos")), "_cos", ["question"], "cos")
    return R.hybrid(near, texts, "cos", "bm25", ["question"], ["doc_id"]).select("question", "doc_id", F.round("score", 4).alias("score"), "method")


@query("r7_vector_top_k", f"SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT q_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, vec_id) AS rank FROM (SELECT q.vec_id AS q_id, e.vec_id, round({_COS}, 9) AS cos FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 8")
def r7(spark, d):
    return vectors.nearest(*embeddings(spark, d), 8).select("q_id", "vec_id", "rank")


_R7 = SQL["r7_vector_top_k"]


def _vector_index(spark, d):
    path, (e, asked) = new_folder(spark, "vectors"), embeddings(spark, d)
    vectors.index(e, path)
    return path, asked


@query("r7_indexed", _R7)
def r7_indexed(spark, d):
    """The stored tables with all probes: the exact search."""
    return vectors.search(*_vector_index(spark, d), probes=None).select("q_id", "vec_id", "rank")


@query("r7_recall")
def r7_recall(spark, d):
    """How much of the exact result the default probes find; tests/test_vectors.py holds both searches against brute force."""
    path, asked = _vector_index(spark, d)
    return vectors.recall(vectors.search(path, asked), vectors.search(path, asked, probes=None))


@query("r9_last_turns", "SELECT conv_id, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 GROUP BY conv_id")
def r9(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = table(spark, d, "conversations").withColumn("_n", F.row_number().over(w)).where("_n <= 4")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("l")))), lambda x: x["l"])
    return t.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("context"))


@query("r10_conversation_pairs", "SELECT conv_id, turn, trim(text) AS q, trim(a) AS a FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant' AND (trim(text) <> '' OR trim(a) <> '')")
def r10(spark, d):
    return R.conversation_pairs(table(spark, d, "conversations"))


_RED = r"regexp_replace(regexp_replace(regexp_replace(text, '1[3-9]\d{9}', '<mobile>', 'g'), '\d{17}[\dXx]', '<id_number>', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g')"


@query("p1_redact", f"SELECT doc_id, md5({_RED}) AS hash FROM documents")
def p1(spark, d):
    r = P.redact(table(spark, d, "documents").select("doc_id", "text"))
    return r.select("doc_id", F.md5(F.regexp_replace("redacted", r"⟦([a-z_]+)_\d+⟧", "<$1>").cast("binary")).alias("hash"))


_MASKED = r"regexp_replace(text, '1[3-9]\d{9}', '<m>', 'g')"


@query("p2_redaction_map", rf"SELECT doc_id, 'mobile' AS kind, unnest(regexp_extract_all(text, '1[3-9]\d{{9}}')) AS original FROM documents UNION ALL SELECT doc_id, 'id_number', unnest(regexp_extract_all({_MASKED}, '\d{{17}}[\dXx]')) FROM documents UNION ALL SELECT doc_id, 'email', unnest(regexp_extract_all(regexp_replace({_MASKED}, '\d{{17}}[\dXx]', '<i>', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')) FROM documents")
def p2(spark, d):
    r = P.redact(table(spark, d, "documents").select("doc_id", "text"))
    return P.redaction_map(r).select("doc_id", F.regexp_extract("placeholder", "^⟦(.*)_[0-9]+⟧$", 1).alias("kind"), "original")


@query("p3_restore", "SELECT doc_id, md5(text) AS hash FROM documents")
def p3(spark, d):
    return P.restore(P.redact(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", F.md5(F.col("restored").cast("binary")).alias("hash"))


@query("e14_select_chunks", f"WITH {ITEMS}, h AS (SELECT *, CAST(contains(line, 'reserved') OR contains(line, 'idiot') AS INT) AS hit FROM items), n AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, max(hit) OVER (PARTITION BY doc_id) = 0 AS degraded FROM h) SELECT doc_id, idx, degraded FROM n WHERE near = 1 OR degraded")
def e14(spark, d):
    i = items(spark, d)
    hit = E.any_clause(F.col("line"), [E.Clause({"w": ["reserved"]}), E.Clause({"w": ["idiot"]})])
    return E.with_neighbours(i, hit, ["doc_id"], ["idx"]).select("doc_id", "idx", "degraded")


@query("e15_date_window", f"WITH {ITEMS}, x AS (SELECT *, DATE '2024-01-01' + CAST((doc_id * 7 + idx) % 120 AS INTEGER) AS day FROM items), h AS (SELECT *, CAST(type = 'text' AND day BETWEEN DATE '2024-02-01' AND DATE '2024-02-10' AS INT) AS hit FROM x), n AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, max(hit) OVER (PARTITION BY doc_id) = 0 AS degraded FROM h) SELECT doc_id, idx FROM n WHERE near = 1 OR degraded OR type <> 'text'")
def e15(spark, d):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("doc_id") * 7 + F.col("idx")) % 120).cast("int")), "yyyy-MM-dd")
    i = items(spark, d).withColumn("dated", F.concat(F.lit("on "), day))
    hit = (F.col("type") == "text") & E.text_matches(F.col("dated"), E.Clause(window=("2024-02-01", "2024-02-10")))
    return E.with_neighbours(i, hit, ["doc_id"], ["idx"], structural=F.col("type") != "text").select("doc_id", "idx")


@query("j4_runtime", "SELECT user_id % 16 AS task_id, round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END) + sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 3) AS total_seconds, round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END) + sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 3) <= 32000 AS within_limit FROM events GROUP BY 1")
def j4(spark, d):
    e = table(spark, d, "events").withColumn("task_id", F.col("user_id") % 16)
    bad = F.col("event_type") == "error"
    return J.runtime(e, "task_id", F.when(~bad, F.col("value")).otherwise(0.0), F.when(bad, F.col("value")).otherwise(0.0), 32000)


@query("j8_route", f"""WITH {ITEMS}, t AS (SELECT doc_id, any_value(lang) = 'en' AS use_model, count(*) FILTER (WHERE type = 'table') > 1 AS multi, count(DISTINCT length(line)) FILTER (WHERE type = 'table') = 1 AS same, count(*) FILTER (WHERE type <> 'table' AND trim(line) <> '') AS n FROM items JOIN documents USING (doc_id) GROUP BY 1)
SELECT doc_id, CASE WHEN NOT use_model THEN 'model_disabled' WHEN multi AND NOT same THEN 'word_multi_parallel' WHEN n > 0 THEN 'semantic_slicing_stack' ELSE 'char_slice_or_direct' END AS track,
CASE WHEN NOT use_model THEN 'skip_llm' ELSE concat('parse_inputs>', CASE WHEN multi AND NOT same THEN concat('parallel_word_table_llm>skip_word_multi_lx_prefill:', CASE WHEN n > 0 THEN 'auto_heterogeneous_tables' ELSE 'auto_no_text_chunks' END) WHEN n > 0 THEN 'semantic_chunks>langextract_or_prompt' ELSE 'char_slice_or_direct_prompt' END, '>process_by_profile>', CASE WHEN multi THEN 'internal_structured_merge>' ELSE '' END, 'write_template') END AS stages FROM t""")
def j8(spark, d):
    """A document's tables are its targets; they have the same columns if all are equally long."""
    i = items(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    is_table = F.col("type") == "table"
    t = i.groupBy("doc_id").agg(
        (F.any_value("lang") == "en").alias("use_model"), (F.count_if(is_table) > 1).alias("multi_table"), (F.countDistinct(F.when(is_table, F.length("line"))) == 1).alias("homogeneous"),
        F.count_if(~is_table & (F.trim("line") != "")).alias("n_text_chunks"),
    )
    return J.route(t).select("doc_id", "track", "stages")


@query("j9_input_kind", "SELECT task_id, string_agg(DISTINCT s, ',' ORDER BY s) AS suffixes, CASE WHEN bool_and(s IN ('csv', 'xlsx')) THEN 'tabular' WHEN bool_and(s = 'txt') THEN 'text' WHEN count(DISTINCT s) = 1 AND bool_and(s IN ('pdf', 'docx')) THEN 'office' ELSE 'mixed' END AS kind FROM (SELECT doc_id // 2 AS task_id, CASE doc_id % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'txt' WHEN 3 THEN 'pdf' ELSE 'docx' END AS s FROM documents) GROUP BY 1")
def j9(spark, d):
    f = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).alias("task_id"), F.element_at(F.array(*[F.lit(x) for x in ("csv", "xlsx", "txt", "pdf", "docx")]), (F.col("doc_id") % 5 + 1).cast("int")).alias("suffix"))
    return J.input_kind(f, "task_id", "suffix")


@query("j5_result_metadata", f"WITH {MESSY} SELECT task_id, count(DISTINCT customer) AS file_count, count(*) AS record_count, count(*) FILTER (WHERE trim(status) = '' OR trim(order_date) = '') AS retried_count, count(*) FILTER (WHERE trim(status) = '' OR trim(order_date) = '') = 0 AS complete FROM messy GROUP BY 1")
def j5(spark, d):
    return J.result_metadata(messy(spark, d), ["task_id"], ["status", "order_date"], "customer")


@query("j12_call_stats", "SELECT event_type AS model, count(*) AS calls, count(*) FILTER (WHERE value < 50) AS successes, count(*) FILTER (WHERE NOT value < 50) AS failures, round(avg(value), 6) AS mean_seconds FROM events GROUP BY ROLLUP (event_type)")
def j12(spark, d):
    return J.call_stats(table(spark, d, "events").withColumnRenamed("event_type", "model"), "model", F.col("value") < 50, "value").withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("j13_latency_histogram", f"SELECT event_type, CAST(b AS DOUBLE) AS bound, count(*) FILTER (WHERE value <= b) AS n FROM events, (VALUES {', '.join(f'({b})' for b in J.LATENCY_BOUNDS)}) v(b) GROUP BY ALL")
def j13(spark, d):
    return J.latency_histogram(table(spark, d, "events"), "value", "event_type")


#: Forms of a model's answer by p_partkey % 10; {n} a name, {s} a size, {m} the size and one.
_ANSWERS = [
    '{"records": [{"name": "{n}", "size": {s}}, {"name": "{n}", "size": {m}',
    '```json\n{"name": "{n}", "size": {s}}\n```',
    '{name: {n}, size: {s}}',
    'Here is the record [as asked]: {"name": "{n}", "size": {s}} Anything else?',
    '{"name": "{n}", "size": {s}}\n{"name": "{n}", "size": {m}}',
    '[{"name": "{n}", "size": {s},}, {"name": "{n}", "size": {m}},]',
    "{'name': '{n}', 'size': {s}, 'more': None}",
    '{"records": [{"name": "{n}", "size": {s}, "more": {"unit": 37.5%}]}',
    "No record found for {n}.",
    '{"name": "{n}", "size" {s}} ',
]
_TWO = "p_partkey % 10 IN (0, 4, 5)"


@query("c15_repair_json", f"""SELECT p_partkey, 0 AS pos, p_name AS name, p_size AS size, CAST(NULL AS VARCHAR) AS reason FROM part WHERE p_partkey % 10 < 8
 UNION ALL SELECT p_partkey, 1, p_name, p_size + 1, NULL FROM part WHERE {_TWO}
 UNION ALL SELECT p_partkey, NULL, NULL, NULL, CASE WHEN p_partkey % 10 = 8 THEN 'no JSON' ELSE 'broken' END FROM part WHERE p_partkey % 10 >= 8""")  # fmt: skip
def c15(spark, d):
    """Truncated, fenced, unquoted, chatty, line by line, with trailing commas, single quotes or missing closers; two forms are
    rejects with their reasons."""
    text = F.element_at(F.array(*[F.lit(x) for x in _ANSWERS]), (F.col("p_partkey") % 10 + 1).cast("int"))
    for mark, value in (("{n}", F.col("p_name")), ("{s}", F.col("p_size").cast("string")), ("{m}", (F.col("p_size") + 1).cast("string"))):
        text = F.replace(text, F.lit(mark), value)
    good, bad = answers.records(table(spark, d, "part").select("p_partkey", text.alias("t")), "t", "name string, size int")
    good = good.select("p_partkey", "pos", "record.name", "record.size").where("name IS NOT NULL")
    return good.unionByName(bad.select("p_partkey", "reason"), allowMissingColumns=True)


@query("k1_prompts", "SELECT doc_id, length(concat('Extract the fields a, b. Answer with one object.', chr(10), 'Only totals.', chr(10), 'Text:', chr(10), text)) AS n, length(concat('Extract the fields a, b. Answer with a list of records, one object for each row.', chr(10), 'Only totals.', chr(10), 'Text:', chr(10), text)) AS n_table, length(concat('Extract the fields a, b. Answer with a list of records, one object for each row.', chr(10), 'Only totals.', chr(10), 'Cover all groups: c = x; c = y.', chr(10), 'Text:', chr(10), text)) AS n_groups FROM documents")
def k1(spark, d):
    docs, form = table(spark, d, "documents").select("doc_id", "text"), {}
    for name, more in (("n", {}), ("n_table", {"mode": "table_records"}), ("n_groups", {"mode": "multi_table", "groups": [("c", "x"), ("c", "y"), ("", "z")]})):
        form[name] = F.length(K.prompt(F.col("text"), ["a", "b"], "Only totals.", **more)).cast("long")
    return docs.select("doc_id", *[c.alias(k) for k, c in form.items()])


@query("k3_rule_records", rf"""WITH {ITEMS} SELECT doc_id, idx, unnest(regexp_extract_all(line, '{K.NUMBER_UNIT}', 1)) AS value FROM items""")
def k3(spark, d):
    r = K.rule_records(items(spark, d).withColumnRenamed("line", "text"))
    return r.where(F.col("field").rlike("^(%|km|kg|USD|元|万元|亿元|人|例)$")).select("doc_id", "idx", "value")


_HEAD = "concat('Extract the fields a. Answer with one object.', chr(10), chr(10), 'Text:', chr(10), {})"


@query("k2_apply_model", f"WITH {ITEMS} SELECT doc_id, idx AS chunk_idx, concat('n=', length({_HEAD.format('line')})) AS response, CAST(NULL AS VARCHAR) AS error FROM items")
def k2(spark, d):
    c = K.prompts(items(spark, d).select("doc_id", F.col("idx").alias("chunk_idx"), F.col("line").alias("text")), ["a"])
    return K.apply_model(c, lambda ps: [f"n={len(p)}" for p in ps])


@query("k5_fallback", f"SELECT doc_id, 0 AS chunk_idx, CAST(length({_HEAD.format('text')}) AS VARCHAR) AS response, CAST(NULL AS VARCHAR) AS error, 'second' AS provider FROM documents")
def k5(spark, d):
    def fragile(ps):
        raise TimeoutError("no answer")

    c = K.prompts(table(spark, d, "documents").select("doc_id", F.lit(0).alias("chunk_idx"), "text"), ["a"])
    return K.with_fallback(c, [("first", fragile), ("second", lambda ps: [str(len(p)) for p in ps])])


@query("k6_embed")
def k6(spark, d):
    t = table(spark, d, "documents").select(F.substring(F.md5(F.col("text").cast("binary")), 1, 16).alias("key"), "text")
    return K.embed(t.dropDuplicates(["key"]))


@query("t2_call_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failures, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t2(spark, d):
    return call_windows(table(spark, d, "events")).withColumn("total", F.round("total", 4))
