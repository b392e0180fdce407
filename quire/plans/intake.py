"""Queries over intake, column choice, value dispatch and reconciling, and over operators that other queries use inside."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import intake, interpret, layout, mapping
from ..operators import predicates as E
from ..operators import privacy as P
from ..operators import records as R
from ..sources.inputs import ITEMS, MESSY, items, messy, table
from ..streaming.arrivals import fresh_documents
from .records import ISO_DATE

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("b17_merged_cells", "SELECT p_partkey AS table_idx, r, c, CASE WHEN c = 0 THEN p_name WHEN r = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS text FROM part, (VALUES (0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)) v(r, c) WHERE NOT (r = 1 AND c = 2)")
def b17(spark, d):
    """The name covers two rows, the brand two columns; the size stands alone below."""
    cell = lambda r, pos, text, h, w: F.struct(F.lit(r).alias("r"), F.lit(pos).alias("pos"), F.col(text).cast("string").alias("text"), F.lit(h).alias("row_span"), F.lit(w).alias("col_span"))
    cells = F.explode(F.array(cell(0, 0, "p_name", 2, 1), cell(0, 1, "p_brand", 1, 2), cell(1, 0, "p_size", 1, 1))).alias("x")
    return layout.expand_spans(table(spark, d, "part").select(F.col("p_partkey").alias("table_idx"), cells).select("table_idx", "x.*", F.lit(3).alias("n_cols")))


@query("c2_fuzzy_alias", "SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS status FROM orders")
def c2(spark, d):
    o = table(spark, d, "orders")
    price, status = (mapping.resolve(n, o.columns, a) for n, a in (("order_total_price", {}), ("state", {"state": ["order_statos"]})))
    return o.select("o_orderkey", F.col(price).alias("price"), F.col(status).alias("status"))


@query("c4_bundle_records", f"WITH {MESSY} SELECT record_idx, customer, trim(amount) AS amount, trim(priority) AS priority, '' AS region FROM messy")
def c4(spark, d):
    """Two source tables with other headers; target tables filter by priority and fix the region."""
    m = messy(spark, d).select("record_idx", "customer", "amount", "priority")
    tables = [m.where("record_idx % 2 = 0"), m.where("record_idx % 2 <> 0").withColumnRenamed("customer", "client")]
    return mapping.bundle_records(tables, ["customer", "amount"], [{"filter_field": "priority"}, {"fixed_values": {"region": "x"}}], {"customer": ["client"]}, keep=["record_idx"])


@query("c13_candidate_columns", f"WITH {MESSY} SELECT record_idx, order_date AS value FROM messy")
def c13(spark, d):
    m = messy(spark, d)
    return m.select("record_idx", F.coalesce(*mapping.candidate_columns(m.columns, "date", {})).alias("value"))


@query("c17_date_column", f"WITH {MESSY} SELECT record_idx, '' AS date FROM messy")
def c17(spark, d):
    m = messy(spark, d)
    has = mapping.with_date_column(m, True)
    return mapping.with_date_column(m.drop("order_date"), has.columns == m.columns).select("record_idx", "date")


@query("d10_dispatch", rf"WITH {MESSY} SELECT record_idx, regexp_extract(replace(amount, ',', ''), '\d+(\.\d+)?') AS money, {ISO_DATE} AS day, trim(regexp_replace(customer, '（预估）', '')) AS name FROM messy")
def d10(spark, d):
    return messy(spark, d).select("record_idx", V.by_type("amount", "money").alias("money"), V.by_type("order_date", "date").alias("day"), V.by_type("customer", "text").alias("name"))


@query("d12_series_value", f"WITH {MESSY} SELECT record_idx, trim(amount) AS by_name, customer AS plain FROM messy")
def d12(spark, d):
    printed = F.concat(F.lit("customer    "), "customer", F.lit("\namount    "), F.trim("amount"), F.lit("\nstatus    "), "status", F.lit("\nName: "), F.col("record_idx").cast("string"), F.lit(", dtype: object"))
    m = messy(spark, d).withColumn("t", printed)
    return m.select("record_idx", V.series_value("t", "amount").alias("by_name"), V.series_value("customer", "customer").alias("plain"))


@query("d31_city_variants", "SELECT c_custkey, c_name, concat(c_name, '市') AS other FROM customer")
def d31(spark, d):
    return table(spark, d, "customer").select("c_custkey", layout.variants(F.col("c_name")).alias("v")).select("c_custkey", F.col("v")[0].alias("c_name"), F.col("v")[1].alias("other"))


@query("d19_field_keywords", rf"WITH {ITEMS} SELECT doc_id, idx, contains(line, '报告病例数') OR contains(line, '报告病例') OR contains(line, 'license') AS hit FROM items")
def d19(spark, d):
    words = interpret.keywords("报告病例数", ["license"])
    return items(spark, d).select("doc_id", "idx", F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains("line", w)).alias("hit"))


@query("d34_text_list", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(concat(p_name, '  ', p_brand, ' '), ' '), lambda x: trim(x)), lambda x: x <> ''), ',') AS v FROM part")
def d34(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(V.text_list(F.split(F.concat("p_name", F.lit("  "), "p_brand", F.lit(" ")), " ")), ",").alias("v"))


@query("e7_date_column", f"WITH {MESSY} SELECT record_idx, {ISO_DATE} AS day FROM messy")
def e7(spark, d):
    m = messy(spark, d)
    return m.select("record_idx", V.date_lenient(E.date_column(m, ["日期"])).alias("day"))


_BLOCKS = "表1：\n监测时间：2024-06-01 08:00\n城市：license\n表2：\n监测时间：2024-06-02\n城市：rights市\n"


@query("e8_range_clause", f"WITH {ITEMS} SELECT doc_id, idx FROM items WHERE DATE '2024-01-01' + CAST((doc_id * 7 + idx) % 120 AS INTEGER) BETWEEN DATE '2024-02-01' AND DATE '2024-02-10'")
def e8(spark, d):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("doc_id") * 7 + F.col("idx")) % 120).cast("int")), "yyyy-MM-dd")
    clauses = layout.compile_instruction("只要 2024年2月10日 到 2024/2/1 的")
    return items(spark, d).where(E.any_clause(F.concat(day, F.lit(" x")), clauses)).select("doc_id", "idx")


@query("e9_block_clauses", f"WITH {ITEMS} SELECT doc_id, idx FROM items WHERE (contains(line, 'license') AND idx % 2 = 0) OR (contains(line, 'rights') AND idx % 2 = 1)")
def e9(spark, d):
    when = F.when(F.col("idx") % 2 == 0, "2024-06-01 ").otherwise("2024-06-02 ")
    return items(spark, d).where(E.any_clause(F.concat(when, "line"), layout.compile_instruction(_BLOCKS))).select("doc_id", "idx")


@query("h9_reconcile", f"""WITH {MESSY}, m AS (SELECT * FROM messy WHERE record_idx = task_id OR (task_id % 3 = 1 AND record_idx % 5 = 0)), t AS (SELECT * FROM messy WHERE record_idx % 3 = 0), c AS (SELECT task_id, (SELECT count(*) FROM m WHERE m.task_id = x.task_id) AS nm, (SELECT count(*) FROM t WHERE t.task_id = x.task_id) AS nt FROM (SELECT DISTINCT task_id FROM messy) x),
s AS (SELECT task_id, CASE WHEN task_id % 2 = 0 AND nm <= 1 AND nt > 0 THEN 'table' ELSE 'model' END AS source FROM c) SELECT task_id, source, record_idx FROM (SELECT *, 'model' AS source FROM m UNION ALL SELECT *, 'table' FROM t) JOIN s USING (task_id, source)""")
def h9(spark, d):
    """Every other task's two target tables have the same columns."""
    m = messy(spark, d)
    header = F.explode(F.array(F.struct(F.lit(0).alias("table_index"), F.lit("a").alias("header")), F.struct(F.lit(1).alias("table_index"), F.when(F.col("task_id") % 2 == 0, "a").otherwise("b").alias("header")))).alias("x")
    headers = m.select("task_id").distinct().select("task_id", header).select("task_id", "x.*")
    return R.reconcile(m.where("record_idx = task_id OR (task_id % 3 = 1 AND record_idx % 5 = 0)"), m.where("record_idx % 3 = 0"), headers, ["task_id"]).select("task_id", "source", "record_idx")


@query("h10_records_view", "SELECT p_partkey, CAST(i AS INTEGER) AS pos, CASE WHEN i = 0 THEN p_name ELSE p_brand END AS name FROM part, (VALUES (0), (1)) v(i) WHERE i = 0 OR p_partkey % 2 = 0")
def h10(spark, d):
    two = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("name")), F.struct(F.col("p_brand").alias("name"))).alias("records")))
    flat = F.to_json(F.struct(F.col("p_name").alias("name"), F.lit("x").alias("_meta")))
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, two).otherwise(flat).alias("j"))
    return intake.records_view(p, "j", ["p_partkey"]).select("p_partkey", "pos", F.col("record")["name"].alias("name"))


@query("p4_remote_only", r"SELECT doc_id, md5(CASE WHEN lang = 'en' THEN regexp_replace(regexp_replace(regexp_replace(text, '1[3-9]\d{9}', '<mobile>', 'g'), '\d{17}[\dXx]', '<id_number>', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g') ELSE text END) AS hash FROM documents")
def p4(spark, d):
    """Texts in English go to a remote model, others to a local one."""
    r = P.redact(table(spark, d, "documents").select("doc_id", "text", "lang"), when=F.col("lang") == "en")
    return r.select("doc_id", F.md5(F.regexp_replace("redacted", r"⟦([a-z_]+)_\d+⟧", "<$1>").cast("binary")).alias("hash"))


@query("t1_fresh_documents", "SELECT count(*) AS n, count(DISTINCT text) AS texts FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)")
def t1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.timestamp_seconds("doc_id").alias("ts"))
    return fresh_documents(docs).agg(F.count("*").alias("n"), F.countDistinct("content_hash").alias("texts"))
