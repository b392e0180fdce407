"""Queries over messy records: values, mapping, filters, dedup, merges, gaps and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import compose
from ..operators import predicates as E
from ..operators import quality as J
from ..operators import records as R
from ..sources.inputs import DUPS, MESSY, dups, messy, table

QUERIES, SQL = {}, {}
COLUMNS = ["customer", "amount", "order_date", "status", "priority"]
_UNITS = "\\s*(" + "|".join(V.DEDUP_UNITS) + ")\\s*$"
_ANNOTATION = V.ANNOTATION_PATTERN


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def per_value(name: str, column, expression, sql: str, where: str = ""):
    """A scalar function over all messy records."""
    q = f"WITH {MESSY} SELECT record_idx, {sql} AS value FROM messy {where}"
    QUERIES[name] = lambda spark, d: (messy(spark, d).where(where.removeprefix("WHERE ")) if where else messy(spark, d)).select("record_idx", expression(F.col(column)).alias("value"))
    SQL[name] = q


_S = "trim(coalesce(%s, ''))"
_NUM = r"regexp_extract(replace(amount, ',', ''), '\d+(?:\.\d+)?')"
_DATE = r"regexp_replace(translate(translate(trim(order_date), '年月/', '---'), '日号', ''), '\s+', '', 'g')"
_RULE_DATE = r"rtrim(regexp_replace(translate(trim(order_date), '年月日号/', '-----'), '\s+', '', 'g'), '-')"
_ISO = lambda s: rf"concat(regexp_extract({s}, '^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})', 1), '-', lpad(regexp_extract({s}, '^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})', 2), 2, '0'), '-', lpad(regexp_extract({s}, '^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})', 3), 2, '0'))"
ISO_DATE = rf"CASE WHEN regexp_matches({_DATE}, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}') THEN {_ISO(_DATE)} ELSE {_DATE} END"
STRICT = lambda k: f"replace(replace(regexp_replace(trim({k}), '{_UNITS}', ''), ',', ''), ' ', '')"
LOOSE = lambda k: f"lower(regexp_replace(replace(regexp_replace(trim(coalesce({k}, '')), '(?i){_UNITS}', ''), ',', ''), '\\s', '', 'g'))"

per_value("d1_strip_annotations", "amount", V.strip_annotations, f"trim(regexp_replace(amount, '{_ANNOTATION}', '', 'g'))")
per_value("d2_normalise_text", "priority", V.normalise_text, f"trim(regexp_replace(trim(priority), '{_ANNOTATION}', '', 'g'))")
per_value("d4_phone_digits", "customer", V.phone_digits, r"regexp_replace(customer, '\D', '', 'g')")
per_value("d5_date_lenient", "order_date", V.date_lenient, ISO_DATE)
per_value("d6_date_by_rule", "order_date", V.date_by_rule, rf"CASE WHEN regexp_matches({_RULE_DATE}, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}') THEN {_ISO(_RULE_DATE)} END")
per_value("d7_money_number", "amount", V.money_number, _NUM)
per_value("d8_clean_number", "amount", lambda c: V.clean_number(c, "text"), r"CASE WHEN regexp_matches(trim(amount), '^[-+]?\d+(?:\.\d+)?\s*[^\d\s]{1,8}$') THEN regexp_extract(trim(amount), '^[-+]?\d+(?:\.\d+)?') ELSE amount END")
per_value("d9_rule_chain", "amount", lambda c: V.by_rule(c, "money", V.MONEY_UNITS), rf"CASE WHEN contains(amount, '亿') THEN regexp_replace(CAST(CAST({_NUM} AS DECIMAL(16,2)) * 100000000 AS VARCHAR), '\.?0*$', '', '') WHEN contains(amount, '万') THEN regexp_replace(CAST(CAST({_NUM} AS DECIMAL(16,2)) * 10000 AS VARCHAR), '\.0*$', '') ELSE {_NUM} END".replace(r"100000000 AS VARCHAR), '\.?0*$', '', '')", r"100000000 AS VARCHAR), '\.0*$', '')"))
per_value("d11_strip_unit", "amount", lambda c: V.strip_unit(c, "万元"), r"CASE WHEN regexp_matches(trim(regexp_replace(trim(amount), '\s*万元\s*$', '')), '^-?[\d,]+(\.\d+)?$') THEN trim(regexp_replace(trim(amount), '\s*万元\s*$', '')) ELSE amount END")
per_value("d13_money_format", "amount", lambda c: V.format_money(V.money_number(c), "with_unit"), rf"CASE WHEN CAST({_NUM} AS DECIMAL(20,2)) = floor(CAST({_NUM} AS DECIMAL(20,2))) THEN concat(CAST(CAST({_NUM} AS DECIMAL(20,2)) AS BIGINT), '元') ELSE concat(CAST({_NUM} AS DECIMAL(20,2)), '元') END")
_D = lambda k: f"substr('零壹贰叁肆伍陆柒捌玖', CAST(n // {k} % 10 AS INTEGER) + 1, 1)"
_P = lambda s, k, r: f"CASE WHEN {s} // {k} % 10 = 0 THEN '零' ELSE concat(substr('零壹贰叁肆伍陆柒捌玖', CAST({s} // {k} % 10 AS INTEGER) + 1, 1), '{r}') END"
_SEC = lambda s: f"regexp_replace(regexp_replace(concat({_P(s, 1000, '仟')}, {_P(s, 100, '佰')}, {_P(s, 10, '拾')}, {_P(s, 1, '')}), '零+', '零', 'g'), '^零|零$', '', 'g')"


@query("d14_upper_amount", f"""SELECT k, CASE WHEN n = 0 THEN '零元整' ELSE concat(regexp_replace(regexp_replace(concat(CASE WHEN n // 10000 % 10000 <> 0 THEN concat({_SEC('(n // 10000 % 10000)')}, '万') WHEN n >= 100000000 THEN '零' ELSE '' END, CASE WHEN n % 10000 <> 0 THEN {_SEC('(n % 10000)')} WHEN n >= 10000 THEN '零' ELSE '' END), '零+', '零', 'g'), '零$', ''), '元整') END AS value
FROM (SELECT l_orderkey * 10 + l_linenumber AS k, CAST(floor(l_extendedprice * (l_linenumber % 3) * 7) AS BIGINT) % 100000000 AS n FROM lineitem)""")
def d14(spark, d):
    n = F.floor(F.col("l_extendedprice") * (F.col("l_linenumber") % 3) * 7).cast("long") % 100_000_000
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), V.upper_amount(n).alias("value"))


per_value("d15_date_format", "order_date", lambda c: V.format_date(V.date_lenient(c), "YYYY年M月D日"), rf"CASE WHEN regexp_matches({_DATE}, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}') THEN concat(regexp_extract({_DATE}, '^(\d{{4}})', 1), '年', CAST(regexp_extract({_DATE}, '^\d{{4}}-(\d{{1,2}})', 1) AS INTEGER), '月', CAST(regexp_extract({_DATE}, '^\d{{4}}-\d{{1,2}}-(\d{{1,2}})', 1) AS INTEGER), '日') ELSE {_DATE} END")
per_value("d25_key_strict", "amount", V.key_strict, STRICT("amount"))
per_value("d26_key_loose", "priority", V.key_loose, LOOSE("priority"))
per_value("d28_first_date", "order_date", V.first_date, rf"CASE WHEN regexp_matches(order_date, '\d{{4}}[-/年]\d{{1,2}}[-/月]\d{{1,2}}') THEN CAST({_ISO(_DATE)} AS DATE) END")
per_value("d33_number_print", "record_idx", lambda c: V.plain_double(c / 2), "CASE WHEN record_idx % 2 = 0 THEN CAST(record_idx // 2 AS VARCHAR) ELSE CAST(record_idx / 2 AS VARCHAR) END")


@query("d3_org_name", """SELECT c_custkey, concat(c_name, CASE WHEN c_custkey % 2 = 0 THEN '有限公司' ELSE '大学' END) AS value FROM customer""")
def d3(spark, d):
    text = F.concat(F.lit("我们和"), F.regexp_replace("c_name", "[#\\s]", ""), F.when(F.col("c_custkey") % 2 == 0, "有限公司").otherwise("大学"), F.lit("签约"))
    return table(spark, d, "customer").select("c_custkey", V.org_name(text).alias("value"))


SQL["d3_org_name"] = r"SELECT c_custkey, concat(regexp_replace(c_name, '[#\s]', '', 'g'), CASE WHEN c_custkey % 2 = 0 THEN '有限公司' ELSE '大学' END) AS value FROM customer"


@query("d29_row_text", f"WITH {MESSY} SELECT record_idx, concat('customer=', customer, ' | status=', status) AS value FROM messy")
def d29(spark, d):
    return messy(spark, d).select("record_idx", V.row_text(["customer", "status"]).alias("value"))


@query("d30_filled_cells", f"WITH {MESSY} SELECT record_idx, (CASE WHEN trim(amount) = '' THEN 0 ELSE 1 END + CASE WHEN trim(order_date) = '' THEN 0 ELSE 1 END + CASE WHEN trim(status) = '' THEN 0 ELSE 1 END) AS value FROM messy")
def d30(spark, d):
    return messy(spark, d).select("record_idx", V.filled_cells(["amount", "order_date", "status"]).alias("value"))


@query("c1_alias_map", f"WITH {MESSY} SELECT record_idx, customer AS \"客户\", amount AS \"金额\", trim(priority) AS \"优先级\" FROM messy")
def c1(spark, d):
    from ..operators.mapping import to_profile

    return to_profile(messy(spark, d), ["客户", "金额", "优先级"], {"客户": ["customer", "cust"], "金额": ["amount"], "优先级": ["priority"]}, keep=["record_idx"])


@query("c3_source_to_profile", f"WITH {MESSY} SELECT record_idx, order_date AS \"日期\", status AS \"状态\", '' AS \"备注\" FROM messy WHERE trim(order_date) <> '' OR trim(status) <> ''")
def c3(spark, d):
    from ..operators.mapping import to_profile

    return to_profile(messy(spark, d), ["日期", "状态", "备注"], {"日期": ["order_date"], "状态": ["status"]}, keep=["record_idx"], drop_blank=True)


@query("c6_header_units", r"SELECT header, regexp_extract(header, '[（(]([^）)]{1,10})[）)]', 1) AS unit, CASE WHEN regexp_extract(header, '[（(]([^）)]{1,10})[）)]', 1) = '%' THEN 'percentage' WHEN regexp_extract(header, '[（(]([^）)]{1,10})[）)]', 1) <> '' THEN 'number' WHEN contains(header, 'date') THEN 'date' ELSE 'text' END AS type FROM (SELECT DISTINCT concat(p_type, CASE p_partkey % 3 WHEN 0 THEN '（%）' WHEN 1 THEN '(kg)' ELSE ' date' END) AS header FROM part)")
def c6(spark, d):
    from ..operators.mapping import header_types

    h = table(spark, d, "part").select(F.concat("p_type", F.element_at(F.array(F.lit("（%）"), F.lit("(kg)"), F.lit(" date")), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("header")).distinct()
    return header_types(h, "header")


@query("c7_leading_text", """SELECT n_regionkey AS table_index, n_name AS header FROM (SELECT *, min(CASE WHEN n_nationkey % 4 = 3 THEN n_nationkey END) OVER (PARTITION BY n_regionkey) AS stop FROM nation) WHERE n_nationkey < coalesce(stop, 1000)""")
def c7(spark, d):
    from ..operators.mapping import leading_text

    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("table_index"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("header"), F.when(F.col("n_nationkey") % 4 == 3, "number").otherwise("text").alias("type"))
    return leading_text(n)


@query("c8_same_columns", "SELECT count(DISTINCT s) = 1 AS same FROM (SELECT string_agg(DISTINCT n_name[1:1], ',' ORDER BY n_name[1:1]) AS s FROM nation GROUP BY n_regionkey)")
def c8(spark, d):
    from ..operators.mapping import same_columns

    return same_columns(table(spark, d, "nation").select(F.col("n_regionkey").alias("table_index"), F.substring("n_name", 1, 1).alias("header")))


@query("c9_header_union", "SELECT p_type AS header, CAST(row_number() OVER (ORDER BY min(p_partkey), p_type) AS BIGINT) AS pos FROM part GROUP BY p_type")
def c9(spark, d):
    from ..operators.mapping import header_union

    return header_union(table(spark, d, "part").select(F.col("p_type").alias("header"), F.col("p_partkey").alias("pos")))


@query("e1_filter_rules", f"WITH {MESSY} SELECT record_idx FROM messy WHERE coalesce(TRY_CAST(trim(replace(amount, ',', '')) AS DOUBLE) > 150000, true) AND trim(status) <> '' AND contains(trim(priority), 'I')")
def e1(spark, d):
    return E.keep_rows(messy(spark, d), [("amount", ">", 150000), ("status", "not_empty"), ("priority", "contains", "I")]).select("record_idx")


@query("e2_conditional_rows", f"WITH {MESSY} SELECT record_idx FROM messy WHERE coalesce(TRY_CAST(trim(replace(amount, ',', '')) AS DOUBLE) <= 150000, false)")
def e2(spark, d):
    return E.matching_rows(messy(spark, d), ("amount", "<=", 150000)).select("record_idx")


@query("e3_replace_text", f"WITH {MESSY} SELECT record_idx, replace(amount, '元', '圆') AS amount, replace(priority, '元', '圆') AS priority, CASE WHEN contains(amount, '元') THEN 1 ELSE 0 END + CASE WHEN contains(priority, '元') THEN 1 ELSE 0 END AS changed FROM messy")
def e3(spark, d):
    return E.replace_text(messy(spark, d).select("record_idx", "amount", "priority"), ["amount", "priority"], "元", "圆").withColumnRenamed("_changed", "changed")


@query("e4_delete_rows", f"WITH {MESSY} SELECT record_idx FROM messy WHERE NOT (contains(amount, '亿') OR contains(priority, 'LOW'))")
def e4(spark, d):
    return E.delete_rows(messy(spark, d), ["amount", "priority"], "亿").where("NOT contains(priority, 'LOW')").select("record_idx")


@query("e5_parse_range", r"SELECT o_orderkey, least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 90 AS INTEGER) AS b FROM orders)")
def e5(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"))
    text = F.concat(F.lit("从"), F.date_format("a", "yyyy年M月d日"), F.lit("到"), F.date_format(F.date_sub("a", (F.col("o_orderkey") % 90).cast("int")), "yyyy/M/d"))
    return o.select("o_orderkey", *E.date_range(text))


@query("e6_date_range_rows", f"WITH {MESSY} SELECT record_idx FROM messy WHERE CASE WHEN order_date <> '' THEN CAST({_ISO(_DATE)} AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' ELSE false END")
def e6(spark, d):
    m = messy(spark, d)
    return E.in_date_range(m, E.date_column(m, ["日期"]), "1995-01-01", "1996-06-30").select("record_idx")


@query("e12_rows_in_scope", f"WITH {MESSY}, h AS (SELECT *, CASE WHEN contains(trim(status), 'F') THEN 'columns' WHEN contains(concat_ws(' | ', concat('record_idx=', record_idx), concat('customer=', customer), concat('amount=', amount), concat('order_date=', order_date), concat('status=', status), concat('priority=', priority)), 'F') THEN 'row_text' END AS route FROM messy) SELECT task_id, record_idx, route FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY record_idx) AS n FROM h WHERE route IS NOT NULL) WHERE n <= 60")
def e12(spark, d):
    return E.rows_in_scope(messy(spark, d), [E.Clause({"status": ["F"]})], {"status": ["status"]}, ["task_id"], "record_idx").select("task_id", "record_idx", "route")


@query("f1_exact_dedup", "SELECT min(l_orderkey * 10 + l_linenumber) AS record_idx, l_returnflag, l_linestatus, l_quantity FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity")
def f1(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_idx"), "l_returnflag", "l_linestatus", "l_quantity")
    return R.exact_dedup(li, ["l_returnflag", "l_linestatus", "l_quantity"])


@query("f2_normalised_dedup", f"WITH {DUPS} SELECT min(record_idx) AS record_idx FROM dups GROUP BY {', '.join(STRICT(k) for k in COLUMNS)}")
def f2(spark, d):
    return R.normalised_dedup(dups(spark, d), COLUMNS).select("record_idx")


@query("f3_keyed_dedup", f"WITH {DUPS} SELECT min(record_idx) AS record_idx FROM dups GROUP BY CASE WHEN {LOOSE('order_date')} = '' AND {LOOSE('status')} = '' THEN concat('R', {', chr(1), '.join(LOOSE(k) for k in COLUMNS)}) ELSE concat('K', {LOOSE('order_date')}, chr(1), {LOOSE('status')}) END")
def f3(spark, d):
    return R.keyed_dedup(dups(spark, d), ["order_date", "status"], COLUMNS).select("record_idx")


@query("f4_choose_keys", "SELECT 'customer' AS field UNION ALL SELECT 'amount'")
def f4(spark, d):
    m = messy(spark, d).withColumn("serial", F.lit(""))
    keys = R.choose_keys(m, ["serial"], [["serial", "amount"], ["customer", "amount"]])
    return m.select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("field")).distinct()


def _merge_sql(best: str) -> str:
    picks = ", ".join(f"{best.format(c=c)} AS {c}" for c in ("amount", "order_date", "priority"))
    return f"WITH {DUPS}, k AS (SELECT *, trim(customer) AS k1, trim(status) AS k2 FROM dups) SELECT k1, k2, {picks}, min(record_idx) AS record_idx, count(*) AS merge_count FROM k WHERE k1 || k2 <> '' GROUP BY k1, k2"


def _merge(strategy):
    def run(spark, d):
        x = dups(spark, d).withColumn("k1", F.trim("customer")).withColumn("k2", F.trim("status"))
        out = R.merge_by_key(x, ["customer", "status"], ["k1", "k2", "amount", "order_date", "priority"], strategy)
        return out.drop("unkeyed")

    return run


for _name, _strategy, _best in (
    ("f5_merge_longest", "non_empty_wins", "arg_max({c}, [length(trim({c})), -record_idx])"),
    ("f5_merge_latest", "latest_wins", "coalesce(arg_max({c}, record_idx) FILTER (WHERE trim({c}) <> ''), arg_max({c}, record_idx))"),
    ("f6_merge_first", "first_wins", "coalesce(arg_min({c}, record_idx) FILTER (WHERE trim({c}) <> ''), arg_min({c}, record_idx))"),
):
    QUERIES[_name], SQL[_name] = _merge(_strategy), _merge_sql(_best)


@query("f7_detect_keys", f"""WITH {MESSY}, h AS (SELECT * FROM messy ORDER BY record_idx LIMIT 100), l AS (SELECT 'record_idx' AS field, 0 AS pos, CAST(record_idx AS VARCHAR) AS v FROM h UNION ALL SELECT 'customer', 1, customer FROM h UNION ALL SELECT 'status', 2, status FROM h UNION ALL SELECT 'priority', 3, priority FROM h),
a AS (SELECT field, pos, count(DISTINCT v) / count(*) AS u, avg(length(v)) AS n, bool_and(regexp_matches(replace(replace(v, '.', ''), '-', ''), '^\\d+$')) AS numeric FROM l WHERE v <> '' GROUP BY field, pos)
SELECT field, score FROM (SELECT field, CAST(CASE WHEN u > 0.9 THEN 3 WHEN u > 0.7 THEN 2 WHEN u > 0.5 THEN 1 ELSE 0 END + 2 * CAST(numeric AS INT) + CAST(n < 20 AS INT) + 2 * CAST(regexp_matches(lower(field), 'id|序号|编号|排名|index|no|number|code') AS INT) AS INTEGER) AS score, pos FROM a) WHERE score >= 3 ORDER BY score DESC, pos LIMIT 5""")
def f7(spark, d):
    return R.detect_keys(messy(spark, d), ["record_idx", "customer", "status", "priority"])


@query("f9_merge_stats", f"WITH {DUPS} SELECT count(*) AS total, count(DISTINCT nullif(trim(customer), '')) + count(*) FILTER (WHERE trim(customer) = '') AS merged, round(1 - count(DISTINCT trim(customer)) / count(*), 6) AS reduction, ['customer'] AS keys FROM dups")
def f9(spark, d):
    _, stats = compose.merge_chunk_results(dups(spark, d), ["customer", "amount"], ["customer"])
    return stats.withColumn("reduction", F.round("reduction", 6))


@query("f11_first_values", f"WITH {MESSY} SELECT task_id, arg_min(status, record_idx) FILTER (WHERE trim(status) <> '') AS status, arg_min(order_date, record_idx) FILTER (WHERE trim(order_date) <> '') AS order_date FROM messy GROUP BY task_id")
def f11(spark, d):
    return R.first_values(messy(spark, d), ["status", "order_date"], ["task_id"])


@query("f12_never_filled", "SELECT 'remark' AS field")
def f12(spark, d):
    return R.never_filled(messy(spark, d).withColumn("remark", F.lit(" ")), ["customer", "status", "remark"])


@query("g1_carry_forward", f"WITH {MESSY} SELECT record_idx, coalesce(last_value(nullif(trim(status), '') IGNORE NULLS) OVER w, '') AS status, coalesce(last_value(nullif(trim(order_date), '') IGNORE NULLS) OVER w, '') AS order_date FROM messy WINDOW w AS (PARTITION BY task_id ORDER BY record_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def g1(spark, d):
    return R.carry_forward(messy(spark, d), ["status", "order_date"], ["task_id"]).select("record_idx", "status", "order_date")


@query("g2_dominant_values", f"WITH {MESSY}, x AS (SELECT task_id, CASE WHEN record_idx % 11 = 0 THEN '' WHEN record_idx % 23 = 0 THEN 'b' ELSE 'a' END AS v FROM messy), n AS (SELECT task_id, v, count(*) AS c FROM x GROUP BY ALL), a AS (SELECT task_id, sum(c) AS r, sum(c) FILTER (WHERE v <> '') AS f, max(c) FILTER (WHERE v <> '') AS top, arg_max(v, c) FILTER (WHERE v <> '') AS value FROM n GROUP BY task_id) SELECT task_id, 'flag' AS field, value FROM a WHERE r >= 4 AND f / r >= 0.4 AND top / f >= 0.85 AND f < r")
def g2(spark, d):
    m = messy(spark, d).withColumn("flag", F.when(F.col("record_idx") % 11 == 0, "").when(F.col("record_idx") % 23 == 0, "b").otherwise("a"))
    return R.dominant_values(m, ["flag"], ["task_id"])


@query("g3_numeric_like", f"WITH {MESSY}, l AS (SELECT 'amount' AS field, trim(amount) AS v FROM messy UNION ALL SELECT 'customer', trim(customer) FROM messy UNION ALL SELECT 'status', trim(status) FROM messy) SELECT field, count(*) AS n, round(avg(CASE WHEN regexp_matches(v, '^[-+]?\\d[\\d,]*(?:\\.\\d+)?\\s*[^\\d\\s]{{0,8}}$') THEN 1 ELSE 0 END), 6) AS share FROM l WHERE v <> '' GROUP BY field HAVING count(*) >= 3 AND avg(CASE WHEN regexp_matches(v, '^[-+]?\\d[\\d,]*(?:\\.\\d+)?\\s*[^\\d\\s]{{0,8}}$') THEN 1 ELSE 0 END) >= 0.7")
def g3(spark, d):
    return R.numeric_like(messy(spark, d), ["amount", "customer", "status"]).withColumn("share", F.round("share", 6))


@query("g5_reading_order", f"WITH {MESSY}, t AS (SELECT doc_id AS task_id, text FROM documents), p AS (SELECT m.task_id, record_idx, CASE WHEN instr(text, lower(substr(trim(priority), 3, 2))) > 0 THEN instr(text, lower(substr(trim(priority), 3, 2))) ELSE 1000000000000000000 END AS position FROM (SELECT * REPLACE (record_idx % (SELECT count(*) FROM documents) AS task_id) FROM messy) m LEFT JOIN t ON m.task_id = t.task_id) SELECT task_id, record_idx, CAST(position AS BIGINT) AS position, CAST(row_number() OVER (PARTITION BY task_id ORDER BY position, record_idx) AS INTEGER) AS rank FROM p")
def g5(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("task_id"), "text")
    size = F.broadcast(t.agg(F.count("*").alias("_n")))  # one row
    m = messy(spark, d).crossJoin(size).withColumn("task_id", F.col("record_idx") % F.col("_n")).drop("_n").withColumn("v", F.lower(F.substring(F.trim("priority"), 3, 2)))
    return R.reading_order(m, t, "v", ["task_id"]).select("task_id", "record_idx", "position", "rank")


SPECS = [(0, "priority", "URGENT", 50, {"status": "done"}), (1, "priority", "HIGH", 0, {"status": " "}), (2, "status", "F", 20, {})]


def specs(spark):
    return spark.createDataFrame(SPECS, "table_index int, filter_field string, filter_value string, max_rows int, fixed_values map<string,string>")


_ASSIGNED = f"{MESSY}, assigned AS (SELECT 0 AS table_index, 50 AS max_rows, task_id, record_idx, customer, amount, order_date, 'done' AS status, priority FROM messy WHERE contains(priority, 'URGENT') UNION ALL SELECT 1, 0, task_id, record_idx, customer, amount, order_date, status, priority FROM messy WHERE contains(priority, 'HIGH') UNION ALL SELECT 2, 20, task_id, record_idx, customer, amount, order_date, status, priority FROM messy WHERE contains(status, 'F'))"


@query("h1_assign", f"WITH {_ASSIGNED} SELECT table_index, record_idx, status FROM assigned")
def h1(spark, d):
    return R.assign(messy(spark, d), specs(spark)).select("table_index", "record_idx", "status")


@query("h3_group_dedup", f"WITH {_ASSIGNED} SELECT table_index, min(record_idx) AS record_idx FROM assigned GROUP BY table_index, CASE WHEN {LOOSE('order_date')} = '' THEN concat('R', {', chr(1), '.join(LOOSE(k) for k in COLUMNS)}) ELSE {LOOSE('order_date')} END")
def h3(spark, d):
    return R.keyed_dedup(R.assign(messy(spark, d), specs(spark)), ["order_date"], COLUMNS, within=["table_index"]).select("table_index", "record_idx")


@query("h4_cap_rows", f"WITH {_ASSIGNED} SELECT table_index, record_idx FROM (SELECT *, row_number() OVER (PARTITION BY table_index ORDER BY record_idx) AS n FROM assigned) WHERE max_rows <= 0 OR n <= max_rows")
def h4(spark, d):
    return R.cap_rows(R.assign(messy(spark, d), specs(spark))).select("table_index", "record_idx")


@query("h6_weak_groups", f"WITH {_ASSIGNED} SELECT table_index, max(CASE WHEN trim(order_date) = '' THEN 0 ELSE 1 END + CASE WHEN trim(status) = '' THEN 0 ELSE 1 END) <= 1 AS weak FROM assigned GROUP BY table_index")
def h6(spark, d):
    return R.weak_groups(R.assign(messy(spark, d), specs(spark)), ["order_date", "status"])


@query("h7_fill_from_pool", f"WITH {_ASSIGNED}, pool AS (SELECT table_index, arg_min(order_date, record_idx) FILTER (WHERE trim(order_date) <> '') AS v FROM assigned GROUP BY table_index) SELECT table_index, record_idx, CASE WHEN trim(order_date) = '' THEN coalesce(v, '') ELSE order_date END AS order_date FROM assigned JOIN pool USING (table_index)")
def h7(spark, d):
    a = R.assign(messy(spark, d), specs(spark))
    return R.fill_from_pool(a, R.first_values(a, ["order_date"], ["table_index"]), ["order_date"]).select("table_index", "record_idx", "order_date")


@query("h8_choose_source", f"WITH {MESSY}, m AS (SELECT * FROM messy WHERE record_idx % 7 = 0 AND task_id % 2 = 0), t AS (SELECT * FROM messy WHERE record_idx % 3 = 0), c AS (SELECT task_id, coalesce(m.n, 0) AS m, coalesce(t.n, 0) AS t FROM (SELECT task_id, count(*) AS n FROM m GROUP BY 1) m FULL JOIN (SELECT task_id, count(*) AS n FROM t GROUP BY 1) t USING (task_id)), s AS (SELECT task_id, CASE WHEN t > 0 AND (m = 0 OR (m <= 1 AND t > greatest(20, 10 * m))) THEN 'table' ELSE 'model' END AS source FROM c) SELECT task_id, source, record_idx FROM (SELECT *, 'model' AS source FROM m UNION ALL SELECT *, 'table' FROM t) JOIN s USING (task_id, source)")
def h8(spark, d):
    m = messy(spark, d)
    return R.choose_source(m.where("record_idx % 7 = 0 AND task_id % 2 = 0"), m.where("record_idx % 3 = 0"), ["task_id"]).select("task_id", "source", "record_idx")


@query("h11_union_merge", f"WITH {DUPS}, k AS (SELECT trim(customer) AS customer, coalesce(arg_min(order_date, record_idx) FILTER (WHERE trim(order_date) <> ''), '') AS order_date FROM dups WHERE trim(customer) <> '' GROUP BY 1) SELECT DISTINCT * FROM k")
def h11(spark, d):
    m = messy(spark, d)
    again = dups(spark, d).where("record_idx >= 1000000")
    return compose.union_merge(m, again.drop("amount"), ["customer"], ["customer", "order_date"]).select("customer", "order_date")


@query("j1_missing_cells", f"WITH {MESSY} SELECT record_idx, 'order_date' AS field FROM messy WHERE trim(order_date) = '' UNION ALL SELECT record_idx, 'status' FROM messy WHERE trim(status) = ''")
def j1(spark, d):
    return R.missing_cells(messy(spark, d), ["order_date", "status"], ["record_idx"])


@query("j2_cell_audit", f"WITH {MESSY}, l AS (SELECT record_idx, 'order_date' AS field, trim(order_date) AS raw, {ISO_DATE} AS final FROM messy UNION ALL SELECT record_idx, 'priority', trim(priority), trim(priority) FROM messy) SELECT *, CASE WHEN final = '' THEN 'empty' WHEN raw = '' THEN 'filled' WHEN raw = final THEN 'kept' ELSE 'changed' END AS status FROM l")
def j2(spark, d):
    m = messy(spark, d)
    return J.cell_audit(m, m.withColumn("order_date", V.date_lenient("order_date")), ["order_date", "priority"])


@query("j10_coverage", f"WITH {MESSY} SELECT DISTINCT concat('C', c_custkey) AS customer FROM customer WHERE concat('C', c_custkey) NOT IN (SELECT customer FROM messy)")
def j10(spark, d):
    return J.coverage(table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("customer")), messy(spark, d), "customer")


@query("j11_fill_rates", f"WITH {MESSY}, l AS (SELECT 'status' AS field, CASE WHEN trim(status) = '' THEN 0 ELSE 1 END AS full_cell FROM messy UNION ALL SELECT 'order_date', CASE WHEN trim(order_date) = '' THEN 0 ELSE 1 END FROM messy) SELECT field, count(*) AS n, round(avg(full_cell), 6) AS fill_rate FROM l GROUP BY ROLLUP (field)")
def j11(spark, d):
    return J.fill_rates(messy(spark, d), ["status", "order_date"]).withColumn("fill_rate", F.round("fill_rate", 6))


@query("k7_postprocess", f"WITH {DUPS}, v AS (SELECT task_id, record_idx, trim(customer) AS customer, {ISO_DATE} AS order_date, trim(status) AS status, regexp_extract(replace(amount, ',', ''), '[-+]?\\d+(?:\\.\\d+)?') AS amount FROM dups), u AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(STRICT(k) for k in ('customer', 'order_date', 'status', 'amount'))} ORDER BY record_idx) AS n FROM v) SELECT record_idx, customer, order_date, status, amount FROM u WHERE n = 1 AND order_date BETWEEN '1994-01-01' AND '1997-12-31'")
def k7(spark, d):
    """Mapping, values, dedup and date range as one plan."""
    x = dups(spark, d).select("task_id", "record_idx", F.trim("customer").alias("customer"), V.date_lenient("order_date").alias("order_date"), F.trim("status").alias("status"), V.clean_number("amount", "money").alias("amount"))
    x = R.normalised_dedup(x, ["customer", "order_date", "status", "amount"])
    return E.in_date_range(x, "order_date", "1994-01-01", "1997-12-31").select("record_idx", "customer", "order_date", "status", "amount")
