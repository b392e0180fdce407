"""Queries over whole stages: filling target tables, post-processing, extraction with and without a target schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compose
from ..operators import infer as K
from ..operators import layout
from ..operators import predicates as E
from ..sources.inputs import DUPS, ITEMS, MESSY, dups, items, messy, table
from .records import ISO_DATE, LOOSE

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: Target tables: one whose group is weak, one that is sound, one without rows, one that nothing matches, one without a filter.
TARGETS = [(0, "priority", "URGENT", 0, {"status": "done"}), (1, "priority", "HIGH", 0, {"status": " "}), (2, "status", "F", 0, {}), (3, "status", "none", 0, {"status": "none"}), (4, "", "", 0, {})]


def targets(spark):
    return spark.createDataFrame(TARGETS, "table_index int, filter_field string, filter_value string, max_rows int, fixed_values map<string,string>")


_GROUPS = f"{MESSY}, grp AS (SELECT 0 AS table_index, '' AS customer, '' AS order_date, 'x' AS status, record_idx FROM messy WHERE contains(priority, 'URGENT') AND record_idx % 5 = 0 UNION ALL SELECT 1, customer, order_date, status, record_idx FROM messy WHERE contains(priority, 'HIGH')), source AS (SELECT * FROM messy WHERE record_idx % 3 = 0)"


def groups(spark, d):
    m = messy(spark, d)
    weak = m.where("contains(priority, 'URGENT') AND record_idx % 5 = 0").select(F.lit(0).alias("table_index"), F.lit("").alias("customer"), F.lit("").alias("order_date"), F.lit("x").alias("status"), "record_idx")
    sound = m.where("contains(priority, 'HIGH')").select(F.lit(1).alias("table_index"), "customer", "order_date", "status", "record_idx")
    return weak.unionByName(sound), m.where("record_idx % 3 = 0")


@query("h5_given_groups", f"WITH {_GROUPS}, u AS (SELECT table_index, min(record_idx) AS record_idx FROM grp GROUP BY table_index, CASE WHEN {LOOSE('customer')} = '' THEN concat('R', {LOOSE('order_date')}, {LOOSE('status')}) ELSE {LOOSE('customer')} END) SELECT * FROM u")
def h5(spark, d):
    """Groups that are there already are deduplicated and capped only."""
    return compose.assigned(None, targets(spark), ["customer"], ["order_date", "status"], groups=groups(spark, d)[0]).select("table_index", "record_idx")


@query("h6_replace_weak", f"""WITH {_GROUPS} SELECT 0 AS table_index, record_idx, customer, order_date, 'done' AS status FROM source WHERE contains(priority, 'URGENT')
 UNION ALL SELECT table_index, record_idx, customer, order_date, status FROM grp WHERE table_index = 1
 UNION ALL SELECT 2, record_idx, customer, order_date, status FROM source WHERE contains(status, 'F') UNION ALL SELECT 3, -1, '', '', 'none'""")
def h6(spark, d):
    g, source = groups(spark, d)
    return compose.replace_weak(g, targets(spark), source, ["customer", "order_date", "status"])


@query("h7_fill_groups", f"""WITH {_GROUPS}, pool AS (SELECT arg_min(order_date, record_idx) FILTER (WHERE trim(order_date) <> '') AS day, arg_min(status, record_idx) FILTER (WHERE trim(status) <> '') AS state FROM source WHERE contains(priority, 'HIGH'))
SELECT 0 AS table_index, record_idx, customer, order_date, status FROM source WHERE contains(priority, 'URGENT')
 UNION ALL SELECT 1, record_idx, customer, CASE WHEN trim(order_date) = '' THEN day ELSE order_date END, CASE WHEN trim(status) = '' THEN state ELSE status END FROM grp, pool WHERE table_index = 1
 UNION ALL SELECT 2, record_idx, customer, order_date, status FROM source WHERE contains(status, 'F') UNION ALL SELECT 4, record_idx, customer, order_date, status FROM source""")
def h7(spark, d):
    g, source = groups(spark, d)
    return compose.fill_groups(g, targets(spark), source, ["customer", "order_date", "status"])


PROFILE = compose.Profile(
    fields={"client": "text", "day": "date", "state": "text", "amount": "money", "flag": "text"},
    aliases={"client": ["customer"], "day": ["order_date"], "state": ["status"]},
    keys=["client", "day"], date_range=("1994-01-01", "1997-12-31"), backfill=["flag"], rules=[("state", "!=", "P"), ("amount", ">", 5000)],
)
_K7 = f"""WITH {DUPS}, v AS (SELECT task_id, record_idx, regexp_replace(trim(customer), '\\s+', ' ', 'g') AS client, {ISO_DATE} AS day, trim(status) AS state, regexp_extract(replace(amount, ',', ''), '[-+]?\\d+(?:\\.\\d+)?') AS amount, CASE WHEN record_idx % 11 = 0 THEN '' ELSE 'a' END AS flag FROM dups),
o AS (SELECT *, row_number() OVER (PARTITION BY {LOOSE('client')}, {LOOSE('day')} ORDER BY record_idx) AS n FROM v), i AS (SELECT * FROM o WHERE n = 1 AND day BETWEEN '1994-01-01' AND '1997-12-31'),
b AS (SELECT * REPLACE (CASE WHEN flag = '' AND count(*) OVER (PARTITION BY task_id) >= 4 THEN 'a' ELSE flag END AS flag), flag = '' AS blank FROM i), k AS (SELECT * FROM b WHERE state <> 'P' AND coalesce(TRY_CAST(amount AS DOUBLE) > 5000, true))"""


def _postprocessed(spark, d):
    x = dups(spark, d).withColumn("flag", F.when(F.col("record_idx") % 11 == 0, "").otherwise("a"))
    return compose.postprocess(x, PROFILE, ["task_id"])


@query("k7_whole", f"{_K7} SELECT task_id, record_idx, client, day, state, amount, flag FROM k")
def k7(spark, d):
    return _postprocessed(spark, d)[0].select("task_id", "record_idx", *PROFILE.fields)


@query("k7_summary", f"""{_K7} SELECT task_id, v.n AS records, coalesce(o.n, 0) AS "distinct", coalesce(i.n, 0) AS in_range, coalesce(k.n, 0) AS kept, coalesce(k.f, 0) AS backfilled FROM (SELECT task_id, count(*) AS n FROM v GROUP BY 1) v
LEFT JOIN (SELECT task_id, count(*) AS n FROM o WHERE n = 1 GROUP BY 1) o USING (task_id) LEFT JOIN (SELECT task_id, count(*) AS n FROM i GROUP BY 1) i USING (task_id) LEFT JOIN (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE blank) AS f FROM k GROUP BY 1) k USING (task_id)""")
def k7_summary(spark, d):
    return _postprocessed(spark, d)[1]


SCHEMA = compose.Profile(fields={"name": "text", "size": "number", "brand": "text"}, aliases={"name": ["item name"], "brand": ["Maker"]}, keys=["name", "size"], required=["name", "brand"])


def parts(spark, d):
    """Parts as chunks of text in four forms; every fifth one repeats the part before it with a brand."""
    form = F.element_at(F.array(F.concat(F.lit("name: "), "p_name", F.lit(", size: "), F.col("p_size").cast("string")), F.concat(F.lit("maker: "), "p_brand", F.lit("\nItem Name: "), "p_name"), F.lit("nothing to see here"), F.concat(F.lit("weight: 3; colour: "), "p_type")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select(F.expr("p_partkey div 8").alias("doc_id"), (F.col("p_partkey") % 8).cast("int").alias("chunk_idx"), form.alias("text"))


_PARTS = "p AS (SELECT p_partkey, p_partkey // 8 AS doc_id, p_partkey % 8 AS chunk_idx, p_partkey % 4 AS f, p_name, p_size, p_brand FROM part)"
_RAW = f"{_PARTS}, raw AS (SELECT doc_id, chunk_idx, doc_id * 1048576 + chunk_idx AS record_idx, p_name AS name, CASE WHEN f = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS size, CASE WHEN f = 1 THEN p_brand ELSE '' END AS brand FROM p WHERE f < 2), fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {LOOSE('name')}, {LOOSE('size')} ORDER BY record_idx) AS n FROM raw) WHERE n = 1)"


@query("k8_records", f"WITH {_RAW} SELECT doc_id, record_idx, name, size, brand FROM fin")
def k8(spark, d):
    return compose.extract(parts(spark, d), SCHEMA)["records"].select("doc_id", "record_idx", *SCHEMA.fields)


@query("k8_rejects", f"WITH {_PARTS} SELECT doc_id, chunk_idx, CASE WHEN f = 2 THEN 'no field' ELSE 'no field of the profile' END AS reason FROM p WHERE f >= 2")
def k8_rejects(spark, d):
    return compose.extract(parts(spark, d), SCHEMA)["rejects"]


@query("k8_audit", f"WITH {_RAW}, l AS (SELECT record_idx, 'name' AS field, name AS v FROM fin UNION ALL SELECT record_idx, 'size', size FROM fin UNION ALL SELECT record_idx, 'brand', brand FROM fin) SELECT record_idx, field, v AS raw, v AS final, CASE WHEN v = '' THEN 'empty' ELSE 'kept' END AS status FROM l")
def k8_audit(spark, d):
    return compose.extract(parts(spark, d), SCHEMA)["audit"]


@query("k8_summary", f"WITH {_RAW}, t AS (SELECT doc_id, count(*) AS chunks FROM p GROUP BY 1) SELECT doc_id, count(fin.record_idx) AS records, count(*) FILTER (WHERE fin.brand = '') AS missing, count(*) FILTER (WHERE fin.brand = '') AS retried, (SELECT count(*) FROM raw WHERE raw.doc_id = t.doc_id) AS extracted FROM t LEFT JOIN fin USING (doc_id) GROUP BY doc_id")
def k8_summary(spark, d):
    return compose.extract(parts(spark, d), SCHEMA)["summary"].select("doc_id", "records", "missing", "retried", "extracted")


@query("k8_without_schema", f"WITH {_PARTS} SELECT DISTINCT doc_id, field, value FROM (SELECT doc_id, 'name' AS field, p_name AS value FROM p WHERE f = 0 UNION ALL SELECT doc_id, 'size', CAST(p_size AS VARCHAR) FROM p WHERE f = 0 UNION ALL SELECT doc_id, 'maker', p_brand FROM p WHERE f = 1 UNION ALL SELECT doc_id, 'Item Name', p_name FROM p WHERE f = 1 UNION ALL SELECT p.doc_id, 'weight', '3' FROM p WHERE f = 3 UNION ALL SELECT p_partkey // 8, 'colour', p_type FROM part WHERE p_partkey % 4 = 3)")
def k8_plain(spark, d):
    return compose.extract(parts(spark, d))["records"].select("doc_id", "field", "value")


@query("k2_rule_model", "SELECT p_partkey // 8 AS doc_id, p_partkey % 8 AS chunk_idx, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS VARCHAR) END AS size FROM part WHERE p_partkey % 4 IN (0, 1)")
def k2(spark, d):
    """The model stage with a model that extracts: it answers prompts in JSON, with prose and a cut end, and answers become records."""
    from ..operators import answers

    def model(prompts):
        import re

        for p in prompts:
            found = re.findall(r"(name|size|maker): ([^,\n]+)", p[p.index("Text:") :])
            yield "Found: {" + ", ".join(f'"{k}": "{v}"' for k, v in found) if found else "nothing"

    c = K.prompts(parts(spark, d), ["name", "size"], mode="table_records")
    good, _ = answers.records(K.apply_model(c, model).drop("error"), "response", "name string, size string")
    return good.select("doc_id", "chunk_idx", "record.name", "record.size")


_DAY = "DATE '2024-01-01' + CAST((doc_id * 7 + idx) % 120 AS INTEGER)"


@query("e15_reasons", f"""WITH {ITEMS}, x AS (SELECT *, type = 'text' AND doc_id % 3 <> 0 AS dated, {_DAY} AS day FROM items), h AS (SELECT *, dated AND day BETWEEN DATE '2024-02-01' AND DATE '2024-02-10' AS hit FROM x),
n AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, bool_or(hit) OVER (PARTITION BY doc_id) AS hits, bool_or(dated) OVER (PARTITION BY doc_id) AS a FROM h),
r AS (SELECT *, CASE WHEN NOT a THEN 'no_parseable_ymd_in_text_chunks' WHEN NOT hits THEN 'no_text_chunk_in_date_window' END AS reason FROM n)
SELECT doc_id, idx, CASE WHEN reason IS NULL THEN 'date_window' ELSE 'date_window_degraded' END AS mode, reason FROM r WHERE reason IS NOT NULL OR near OR type <> 'text'""")
def e15(spark, d):
    """Documents whose text has no dates at all, none in the window, or some."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("doc_id") * 7 + F.col("idx")) % 120).cast("int")), "yyyy-MM-dd")
    i = items(spark, d).withColumn("dated", F.when(F.col("doc_id") % 3 == 0, "no day").otherwise(F.concat(F.lit("on "), day)))
    return E.chunks_in_window(i, ["doc_id"], ["idx"], "dated", F.col("type") != "text", "2024-02-01", "2024-02-10").select("doc_id", "idx", "mode", "reason")


@query("c16_unit_summary", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 3 END AS unit_count, CASE WHEN p_partkey % 3 = 0 THEN ['city', 'unknown'] ELSE [p_brand, 'city', 'unknown'] END AS unit_types, p_size AS size, p_name AS name FROM part")
def c16(spark, d):
    """Units with fields as an object, as pairs and as keys of their own; every third answer has a unit that is no object."""
    unit = F.concat(F.lit('{"units": [{"unit_type": "city", "fields": {"size": '), F.col("p_size").cast("string"), F.lit('}}, {"name": "'), "p_name", F.lit('", "confidence": 3}, '), F.when(F.col("p_partkey") % 3 == 0, F.lit('"none"')).otherwise(F.concat(F.lit('{"unit_type": "'), "p_brand", F.lit('", "fields": [{"key": "k", "value": "v"}]}'))), F.lit("]}"))
    u = layout.units(table(spark, d, "part").select("p_partkey", unit.alias("j")), "j")
    named = u.groupBy("p_partkey").agg(F.max(F.try_element_at("fields", F.lit("size"))).cast("int").alias("size"), F.max(F.try_element_at("fields", F.lit("name"))).alias("name"))
    return layout.unit_summary(u, ["p_partkey"]).drop("mean_confidence").join(named, "p_partkey")
