"""Queries over ingest, interpretation, constraints, fuzzy merges, table layout and the whole extraction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import compose
from ..operators import chunks as C
from ..operators import fuzzy, interpret, layout
from ..operators import infer as K
from ..operators import mapping
from ..operators import predicates as E
from ..operators import quality as J
from ..operators import records as R
from ..operators import retrieval
from ..sources.inputs import DUPS, ITEMS, MESSY, dups, items, messy, table
from .records import _ASSIGNED, ISO_DATE, LOOSE, STRICT, specs

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("a7_ingest_rows", f"WITH {MESSY} SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY record_idx) - 1 AS row_index, concat('{{\"customer\":\"', customer, '\",\"status\":\"', status, '\"}}') AS record_data FROM messy")
def a7(spark, d):
    m = messy(spark, d)
    n = (F.row_number().over(Window.partitionBy("task_id").orderBy("record_idx")) - 1).cast("long")
    return m.select("task_id", n.alias("row_index"), F.to_json(F.struct("customer", "status")).alias("record_data"))


@query("a8_ingest_summary", "SELECT doc_id % 16 AS task_id, count(*) AS files, count(*) FILTER (WHERE doc_id % 3 = 0) AS structured, sum(n_chars) AS chars, string_agg(CASE WHEN length(text) < 40 THEN concat(doc_id, '') END, ',' ORDER BY doc_id) AS errors FROM documents GROUP BY 1")
def a8(spark, d):
    t = table(spark, d, "documents").withColumn("task_id", F.col("doc_id") % 16)
    bad = F.array_sort(F.collect_list(F.when(F.length("text") < 40, F.col("doc_id"))))
    return t.groupBy("task_id").agg(F.count("*").alias("files"), F.count_if(F.col("doc_id") % 3 == 0).alias("structured"), F.sum("n_chars").alias("chars"), F.nullif(F.array_join(bad.cast("array<string>"), ","), F.lit("")).alias("errors"))


@query("a9_raw_preview", "SELECT doc_id, substr(text, 1, 500) AS preview FROM documents WHERE doc_id % 16 = 3 ORDER BY doc_id LIMIT 20")
def a9(spark, d):
    return table(spark, d, "documents").where("doc_id % 16 = 3").orderBy("doc_id").limit(20).select("doc_id", F.substring("text", 1, 500).alias("preview"))


@query("a10_output_groups", "SELECT CASE WHEN doc_id % 4 = 0 THEN 'merged' ELSE source END AS output, count(*) AS n FROM documents GROUP BY 1")
def a10(spark, d):
    t = table(spark, d, "documents").withColumn("_source_file", F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("source")))
    return t.groupBy(F.coalesce(F.nullif(F.trim("_source_file"), F.lit("")), F.lit("merged")).alias("output")).agg(F.count("*").alias("n"))


@query("a13_numbered_context", f"WITH {ITEMS} SELECT doc_id, string_agg(concat('[chunk ', n, ']', chr(10), line), chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM items WHERE trim(line) <> '') WHERE n <= 3 GROUP BY doc_id")
def a13(spark, d):
    i = items(spark, d).where(F.trim("line") != "").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))).where("n <= 3")
    one = F.concat(F.lit("[chunk "), F.col("n").cast("string"), F.lit("]\n"), "line")
    return i.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("t")))), lambda x: x["t"]), "\n").alias("context"))


@query("a14_union_columns", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier")
def a14(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    return c.unionByName(s, allowMissingColumns=True)


@query("a15_instruction", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name END), ''), nullif(trim(p_type), ''), 'none') AS instruction FROM part")
def a15(spark, d):
    p = table(spark, d, "part").withColumn("own", F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_name")))
    return p.select("p_partkey", F.coalesce(F.nullif(F.trim("own"), F.lit("")), F.nullif(F.trim("p_type"), F.lit("")), F.lit("none")).alias("instruction"))


@query("a16_dictionary", "SELECT lower(alias) AS alias, max(canonical) AS canonical FROM (SELECT n_name AS alias, r_name AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name FROM region) GROUP BY 1")
def a16(spark, d):
    r = table(spark, d, "region")
    n = table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("canonical")).agg(F.collect_list("n_name").alias("names"))
    return n.select(F.explode(F.concat("names", F.array("canonical"))).alias("alias"), "canonical").groupBy(F.lower("alias").alias("alias")).agg(F.max("canonical").alias("canonical"))


@query("b14_head_and_tail", f"WITH {ITEMS}, s AS (SELECT doc_id, idx, sum(length(line)) OVER (PARTITION BY doc_id) AS total, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY idx) AS up, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY idx DESC) AS down FROM items) SELECT doc_id, idx, CASE WHEN up <= floor(total * 0.06) THEN 'head' ELSE 'tail' END AS part FROM s WHERE up <= floor(total * 0.06) OR down <= floor(total * 0.04)")
def b14_ends(spark, d):
    i = items(spark, d).select("doc_id", F.col("idx").alias("pos"), F.col("line").alias("text"))
    return layout.head_and_tail(i).select("doc_id", F.col("pos").alias("idx"), "part")


@query("b14_sample", f"""WITH {ITEMS}, a AS (SELECT doc_id, idx, line, sum(length(line)) OVER (PARTITION BY doc_id) + count(*) OVER (PARTITION BY doc_id) - 1 AS total, count(*) OVER (PARTITION BY doc_id) AS n, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY idx) AS up, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY idx DESC) AS down, regexp_matches(line, '[0-9]') AS digits FROM items),
b AS (SELECT *, idx >= n // 4 AND idx < 3 * n // 4 AS inside FROM a),
c AS (SELECT *, count(*) FILTER (WHERE inside AND digits) OVER (PARTITION BY doc_id) < 3 AS few, count(*) FILTER (WHERE inside AND NOT digits) OVER (PARTITION BY doc_id ORDER BY idx) AS other FROM b),
m AS (SELECT doc_id, idx, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY digits DESC, idx) AS s FROM c WHERE inside AND (digits OR (few AND other <= 5))),
p AS (SELECT c.doc_id, c.idx, line, CASE WHEN total < 5000 THEN 'whole' WHEN up <= floor(total * 0.06) THEN 'head' WHEN down <= floor(total * 0.04) THEN 'tail' WHEN s <= floor(total * 0.05) THEN 'middle' END AS part FROM c LEFT JOIN m ON m.doc_id = c.doc_id AND m.idx = c.idx)
SELECT doc_id, idx, part FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY CASE part WHEN 'middle' THEN 2 WHEN 'tail' THEN 1 ELSE 0 END, idx) AS again FROM p WHERE part IS NOT NULL AND trim(line) <> '') WHERE again = 1 OR part = 'whole'""")
def b14(spark, d):
    i = items(spark, d).select("doc_id", F.col("idx").alias("pos"), F.col("line").alias("text"))
    return layout.sampled(i).select("doc_id", F.col("pos").alias("idx"), "part")


@query("c5_containment_keys", f"WITH {MESSY} SELECT record_idx, customer AS \"customer name\", trim(priority) AS prior FROM messy")
def c5(spark, d):
    return mapping.to_profile(messy(spark, d), ["customer name", "prior"], {}, keep=["record_idx"])


@query("c10_sheet_layout", "SELECT o_custkey AS table_idx, CASE WHEN n >= 3 AND o_custkey % 2 = 0 THEN 'vertical' WHEN o_custkey % 2 = 1 THEN 'table' ELSE 'unknown' END AS layout, CASE WHEN o_custkey % 2 = 1 THEN 1 END AS header_row FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def c10(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("table_idx"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("r"), "o_orderpriority", "o_orderstatus")
    cells = o.select("table_idx", "r", F.posexplode(F.array("o_orderpriority", F.when(F.col("table_idx") % 2 == 1, F.col("o_orderstatus")))).alias("c", "text")).withColumn("c", F.col("c") + 1)
    return layout.sheet_layout(cells)


@query("c11_conform", f"WITH {MESSY} SELECT record_idx, coalesce(nullif(trim(order_date), ''), nullif(trim(status), ''), '') AS value FROM messy")
def c11(spark, d):
    return messy(spark, d).select("record_idx", layout.conform(["order_date", "status"]).alias("value"))


@query("c12_fill_missing", f"WITH {MESSY} SELECT record_idx, customer, '' AS remark FROM messy WHERE record_idx % 2 = 0 UNION ALL SELECT record_idx, customer, 'odd' FROM messy WHERE record_idx % 2 = 1")
def c12(spark, d):
    m = messy(spark, d).select("record_idx", "customer")
    return m.where("record_idx % 2 = 0").unionByName(m.where("record_idx % 2 = 1").withColumn("remark", F.lit("odd")), allowMissingColumns=True).na.fill("")


@query("c14_flatten", "SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'g1' ELSE p_name END AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def c14(spark, d):
    inner = F.to_json(F.struct(F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.col("p_name")).alias("name"), F.col("p_size").alias("size")))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit('{"outer": {"g1": '), inner, F.lit("}}")).alias("j"))
    f = layout.flatten_records(p, "j", ["name", "size"])
    return f.select("key", F.col("record")["name"].alias("name"), F.col("record")["size"].alias("size"))


@query("c16_units", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('u', p_size) ELSE 'unit_001' END AS unit_id, 'unknown' AS unit_type, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.8 ELSE 0.0 END AS confidence FROM part")
def c16(spark, d):
    conf = F.element_at(F.array(F.lit("7"), F.lit("0.5"), F.lit('"high"'), F.lit("-1")), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"unit_id": "u'), F.col("p_size").cast("string"), F.lit('", '))).otherwise("")
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit('{"units": [{'), name, F.lit('"confidence": '), conf, F.lit("}]}")).alias("j"))
    return layout.units(p, "j").select("p_partkey", "unit_id", "unit_type", "confidence")


@query("c18_instruction_pairs", "SELECT n_nationkey AS table_index, CASE WHEN n_nationkey % 2 = 0 THEN '区域' ELSE '名称' END AS filter_field, CASE WHEN n_nationkey % 2 = 0 THEN concat(n_regionkey, '') ELSE n_name END AS filter_value FROM nation")
def c18(spark, d):
    text = F.concat(F.lit("说明文字\n名称："), "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("\n其他：x\n地区: "), F.col("n_regionkey").cast("string"))).otherwise(""))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("table_index"), text.alias("t"))
    return layout.instruction_pairs(n, "t", ["名称", "区域"], {"地区": "区域"}).select("table_index", "filter_field", "filter_value")


@query("d16_format_values", f"WITH {MESSY} SELECT record_idx, {ISO_DATE} AS \"date\", trim(priority) AS text FROM messy")
def d16(spark, d):
    return messy(spark, d).select("record_idx", V.format_date(V.date_lenient("order_date")).alias("date"), V.normalise_text("priority").alias("text"))


_CASES = "CASE l_linenumber % 4 WHEN 0 THEN '本地无新增病例' WHEN 1 THEN concat('新增 ', CAST(l_quantity AS INTEGER), ' 例，其中境外 3 例') WHEN 2 THEN concat('其中甲 ', CAST(l_quantity AS INTEGER), ' 例、乙 2 例') ELSE '暂不公布' END"


def phrases(spark, d):
    n = F.col("l_quantity").cast("int").cast("string")
    text = F.element_at(F.array(F.lit("本地无新增病例"), F.concat(F.lit("新增 "), n, F.lit(" 例，其中境外 3 例")), F.concat(F.lit("其中甲 "), n, F.lit(" 例、乙 2 例")), F.lit("暂不公布")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t"), n.alias("n"))


@query("d17_explicit_zero", "SELECT l_orderkey, l_linenumber, l_linenumber % 4 = 0 AS zero FROM lineitem")
def d17(spark, d):
    return phrases(spark, d).select("l_orderkey", "l_linenumber", interpret.explicit_zero(F.col("t"), ["病例"]).alias("zero"))


@query("d18_semantic_number", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '0' WHEN 1 THEN concat(CAST(l_quantity AS INTEGER), '') WHEN 2 THEN concat(CAST(l_quantity AS INTEGER) + 2, '') ELSE '' END AS value FROM lineitem")
def d18(spark, d):
    return phrases(spark, d).select("l_orderkey", "l_linenumber", interpret.semantic_number(F.col("t"), ["病例"]).alias("value"))


@query("d20_anchor", f"WITH {MESSY} SELECT record_idx, CASE WHEN length(trim(status)) BETWEEN 2 AND 20 THEN trim(status) WHEN NOT regexp_matches(priority, '\\d') AND length(trim(priority)) BETWEEN 2 AND 20 THEN trim(priority) ELSE '' END AS anchor FROM messy")
def d20(spark, d):
    return messy(spark, d).select("record_idx", interpret.anchor(["status", "priority"]).alias("anchor"))


_PARTS = "(SELECT DISTINCT item_id, part FROM (SELECT item_id, unnest(string_split(text, '. ')) AS part FROM benchmark) WHERE part <> '')"


@query("d21_snippet", f"SELECT item_id, part, doc_id, substr(text, CAST(greatest(1, instr(text, part) - 520) AS BIGINT), CAST(instr(text, part) + length(part) + 520 - greatest(1, instr(text, part) - 520) AS BIGINT)) AS snippet FROM {_PARTS} b JOIN documents d ON contains(d.text, part)")
def d21(spark, d):
    """Each sentence of each item in all documents that hold it."""
    b = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", r"\. ")).alias("part")).where("part <> ''").distinct()
    hit = E.holders(table(spark, d, "documents").select("doc_id", "text"), b, "part")
    return hit.select("item_id", "part", "doc_id", interpret.snippet(F.col("text"), F.col("part")).alias("snippet"))


@query("d22_interpret", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '0' WHEN 1 THEN concat(CAST(l_quantity AS INTEGER), '') WHEN 2 THEN concat(CAST(l_quantity AS INTEGER) + 2, '') ELSE concat(CAST(l_quantity AS INTEGER), '') END AS value FROM lineitem")
def d22(spark, d):
    p = phrases(spark, d).withColumn("src", F.concat(F.lit("某省报告病例 "), "n", F.lit(" 起")))
    return p.withColumn("name", F.lit("某省")).select("l_orderkey", "l_linenumber", interpret.interpret("t", "病例数", "number", F.col("src"), ["name"]).alias("value"))


@query("d23_company", "SELECT c_custkey, concat(regexp_replace(c_name, '[#\\s]', '', 'g'), '科技有限公司') AS value FROM customer")
def d23(spark, d):
    return table(spark, d, "customer").select("c_custkey", interpret.company(F.concat(F.lit("我方，"), F.regexp_replace("c_name", r"[#\s]", ""), F.lit("科技有限公司与别的有限公司"))).alias("value"))


@query("d24_project_title", "SELECT p_partkey, trim(p_name) AS value FROM part")
def d24(spark, d):
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("这次“"), "p_name", F.lit("”签约"))).otherwise(F.concat(F.lit("签的是"), "p_name", F.lit("这个项目")))
    return table(spark, d, "part").select("p_partkey", interpret.project_title(t).alias("value"))


@query("e10_text_matches", f"WITH {ITEMS} SELECT doc_id, idx FROM items WHERE contains(line, 'license') AND (contains(line, 'Public') OR contains(line, 'rights'))")
def e10(spark, d):
    return items(spark, d).where(E.text_matches(F.col("line"), E.Clause({"a": ["license"], "b": ["Public", "rights"]}))).select("doc_id", "idx")


@query("e10_one_pass", "SELECT doc_id FROM documents WHERE contains(text, 'license') AND (contains(text, 'Public') OR contains(text, 'rights') OR contains(text, 'owner'))")
def e10_one_pass(spark, d):
    return E.holding_any(table(spark, d, "documents").select("doc_id", "text"), E.Clause({"a": ["license"], "b": ["Public", "rights", "owner"]})).select("doc_id")


@query("e11_row_constraint", f"WITH {MESSY} SELECT record_idx FROM messy WHERE contains(status, 'P') OR contains(priority, 'LOW')")
def e11(spark, d):
    return messy(spark, d).where(E.any_clause(F.col("status"), [E.Clause({"s": ["P"]})]) | E.any_clause(F.col("priority"), [E.Clause({"p": ["LOW"]})])).select("record_idx")


@query("e13_scoped_chunk", f"WITH {MESSY}, s AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY record_idx) AS n FROM messy WHERE contains(status, 'F')) SELECT task_id, concat('[scoped_table:', task_id, '] ', '| record_idx | status |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', record_idx, ' | ', status, ' |'), chr(10) ORDER BY record_idx)) AS text FROM s WHERE n <= 60 GROUP BY task_id")
def e13(spark, d):
    s = E.rows_in_scope(messy(spark, d).select("task_id", "record_idx", "status"), [E.Clause({"status": ["F"]})], {"status": ["status"]}, ["task_id"], "record_idx")
    md = C.to_markdown(s, ["task_id"], "record_idx", ["record_idx", "status"])
    return md.select("task_id", F.concat(F.lit("[scoped_table:"), F.col("task_id").cast("string"), F.lit("] "), "markdown").alias("text"))


@query("e16_scope_counts", f"WITH {ITEMS}, h AS (SELECT doc_id, max(CAST(contains(line, 'reserved') AS INT)) AS hit, max(CAST(type = 'table' AND contains(line, 'reserved') AS INT)) AS table_hit FROM items GROUP BY doc_id) SELECT CASE WHEN table_hit = 1 THEN 'table_rows' WHEN hit = 1 THEN 'chunks' ELSE 'passthrough' END AS mode, count(*) AS docs FROM h GROUP BY 1")
def e16(spark, d):
    hit = E.text_matches(F.col("line"), E.Clause({"w": ["reserved"]}))
    h = items(spark, d).groupBy("doc_id").agg(F.bool_or(hit).alias("hit"), F.bool_or(hit & (F.col("type") == "table")).alias("t"))
    return h.groupBy(F.when(F.col("t"), "table_rows").when(F.col("hit"), "chunks").otherwise("passthrough").alias("mode")).agg(F.count("*").alias("docs"))


@query("f8_fuzzy_merge")
def f8(spark, d):
    """Similar customer records without a key."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("record_idx"), F.concat("c_name", F.lit(" "), "c_mktsegment").alias("who"), F.col("c_acctbal").cast("string").alias("balance"))
    again = c.where("record_idx % 5 = 0").select((F.col("record_idx") + 10_000_000).alias("record_idx"), F.concat("who", F.lit("x")).alias("who"), "balance")
    return fuzzy.fuzzy_merge(c.union(again), ["who", "balance"], 0.98)


@query("f10_merge_entry", f"WITH {DUPS} SELECT trim(customer) AS customer, count(*) AS merge_count FROM dups WHERE trim(customer) <> '' GROUP BY 1")
def f10(spark, d):
    """With keys given, nothing is merged by similarity."""
    x = dups(spark, d).withColumn("customer", F.trim("customer")).withColumn("_note", F.lit("x"))
    return compose.merge_records(x, ["customer", "_note"], ["customer"]).select("customer", "merge_count")


@query("g4_anchor_backfill", f"WITH {MESSY} SELECT record_idx, CASE WHEN task_id % 2 = 0 THEN customer ELSE concat('g', record_idx // 16 % 2) END AS grp FROM messy")
def g4(spark, d):
    m = messy(spark, d).withColumn("grp", F.when(F.col("task_id") % 2 == 0, "all").otherwise(F.concat(F.lit("g"), (F.floor(F.col("record_idx") / 16) % 2).cast("string")))).withColumn("_anchor_text", F.col("customer"))
    return layout.anchor_backfill(m, "grp", ["task_id"]).select("record_idx", "grp")


@query("h2_fixed_values", f"WITH {_ASSIGNED} SELECT table_index, status, count(*) AS n FROM assigned GROUP BY ALL")
def h2(spark, d):
    return R.assign(messy(spark, d), specs(spark)).groupBy("table_index", "status").agg(F.count("*").alias("n"))


@query("h5_assign_pipeline", f"WITH {_ASSIGNED}, u AS (SELECT table_index, any_value(max_rows) AS max_rows, min(record_idx) AS record_idx FROM assigned GROUP BY table_index, CASE WHEN {LOOSE('customer')} = '' THEN concat('R', {', chr(1), '.join(LOOSE(k) for k in ('customer', 'status'))}) ELSE {LOOSE('customer')} END) SELECT table_index, record_idx FROM (SELECT *, row_number() OVER (PARTITION BY table_index ORDER BY record_idx) AS n FROM u) WHERE max_rows <= 0 OR n <= max_rows")
def h5(spark, d):
    return compose.assigned(messy(spark, d), specs(spark), ["customer"], ["customer", "status"]).select("table_index", "record_idx")


@query("j3_run_summary", f"""WITH {MESSY}, c AS (SELECT user_id % 16 AS task_id, sum(value) AS seconds FROM events GROUP BY 1)
SELECT task_id, count(*) AS records, sum(length(amount)) AS chars, count(*) FILTER (WHERE trim(status) = '') + count(*) FILTER (WHERE trim(order_date) = '') AS missing, count(*) FILTER (WHERE trim(status) = '' OR trim(order_date) = '') AS retried, round(coalesce(any_value(seconds), 0), 3) AS seconds FROM messy LEFT JOIN c USING (task_id) GROUP BY task_id""")
def j3(spark, d):
    m = messy(spark, d)
    calls = table(spark, d, "events").select((F.col("user_id") % 16).alias("task_id"), F.col("value").alias("seconds"))
    return compose.run_summary(m, ["task_id"], ["status", "order_date"], m.withColumnRenamed("amount", "text"), calls).withColumn("seconds", F.round("seconds", 3))


@query("j7_timeout", "SELECT task_id, CASE WHEN task_id % 2 = 0 THEN least(300, greatest(30, CAST(floor(1.5 * (2 + 3 * chunks)) + 10 AS BIGINT))) ELSE 120 END AS timeout FROM (SELECT doc_id // 4 AS task_id, greatest(1, CAST(sum(n_chars) // 3000 AS BIGINT)) AS chunks FROM documents GROUP BY 1)")
def j7(spark, d):
    f = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 4).alias("task_id"), "n_chars", F.lit("txt").alias("suffix"))
    given = F.when(F.col("task_id") % 2 == 0, 240).otherwise(120)  # every other caller left the default
    return J.complexity(f, "task_id", "n_chars", "suffix").select("task_id", J.timeout(given, F.col("seconds"), 240).alias("timeout"))


@query("j14_output_groups", "SELECT source AS stem, count(*) AS outputs, (SELECT count(DISTINCT source) > 1 FROM documents) AS multi FROM documents GROUP BY source")
def j14(spark, d):
    kind = F.element_at(F.array(F.lit("_result.json"), F.lit("_result.xlsx"), F.lit(".docx")), (F.col("doc_id") % 3 + 1).cast("int"))
    f = table(spark, d, "documents").select(F.concat("source", kind).alias("file"))
    stems = f.groupBy(F.regexp_extract("file", r"^(.*?)(?:_result)?\.[a-z]+$", 1).alias("stem")).agg(F.count("*").alias("outputs"))
    return stems.crossJoin(F.broadcast(stems.agg((F.count("*") > 1).alias("multi"))))


@query("k4_second_pass", f"WITH {MESSY} SELECT record_idx, CASE WHEN trim(status) = '' THEN concat('n=', length(concat('Extract the fields status. Answer with one object.', chr(10), chr(10), 'Text:', chr(10), amount))) ELSE status END AS status FROM messy")
def k4(spark, d):
    """Records with a missing required cell go to a second pass; its answers fill the gaps."""
    return K.second_pass(messy(spark, d), "status", F.col("amount"), lambda ps: [f"n={len(p)}" for p in ps]).select("record_idx", "status")


@query("k8_end_to_end")
def k8(spark, d):
    """Documents to records: chunks, scope, rule extractor, merge and dedup as one plan."""
    i = items(spark, d).where(F.trim("line") != "").withColumnRenamed("line", "text")
    i = E.with_neighbours(i, F.col("text").contains(":"), ["doc_id"], ["idx"])
    r = K.rule_records(i.drop("degraded"))
    r = r.withColumn("record_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx", "pos")))
    return R.normalised_dedup(r, ["field", "value"], within=["doc_id"]).select("doc_id", "idx", "field", "value")


@query("r5_type_boost", f"WITH {ITEMS} SELECT doc_id, idx, round(length(line) * CASE type WHEN 'table' THEN 1.2 WHEN 'formula' THEN 1.1 WHEN 'code' THEN 1.05 ELSE 1.0 END, 6) AS score FROM items")
def r5(spark, d):
    return items(spark, d).select("doc_id", "idx", F.round(F.length("line") * retrieval.boost("type"), 6).alias("score"))


@query("f2_removed_count", f"WITH {DUPS} SELECT count(*) AS before_rows, count(DISTINCT concat_ws(chr(1), {', '.join(STRICT(k) for k in ('customer', 'amount'))})) AS after_rows FROM dups")
def f2_count(spark, d):
    x = dups(spark, d)
    return x.agg(F.count("*").alias("before_rows")).crossJoin(R.normalised_dedup(x, ["customer", "amount"]).agg(F.count("*").alias("after_rows")))
