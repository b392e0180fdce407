"""Tables of a folder, and the messy inputs that the record queries derive from them.

The select lists are plain SQL that Spark and other engines read alike, so a query and its check start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSY_COLUMNS = """
o_orderkey % 16 AS task_id, o_orderkey AS record_idx, concat('C', o_custkey) AS customer,
concat(CAST(o_totalprice AS DECIMAL(15,2)), CASE o_orderkey % 5 WHEN 0 THEN '元' WHEN 1 THEN ' 万元' WHEN 2 THEN '' WHEN 3 THEN '亿' ELSE '（预估）' END) AS amount,
CASE o_orderkey % 4 WHEN 0 THEN concat(year(o_orderdate), '年', month(o_orderdate), '月', day(o_orderdate), '日')
 WHEN 1 THEN concat(year(o_orderdate), '/', month(o_orderdate), '/', day(o_orderdate))
 WHEN 2 THEN concat(year(o_orderdate), '-', lpad(concat(month(o_orderdate), ''), 2, '0'), '-', lpad(concat(day(o_orderdate), ''), 2, '0')) ELSE '' END AS order_date,
CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus END AS status, concat('  ', o_orderpriority, ' ') AS priority
""".strip()
MESSY = f"messy AS (SELECT {MESSY_COLUMNS} FROM orders)"
DUPS = f"""{MESSY}, dups AS (SELECT * FROM messy UNION ALL SELECT task_id, record_idx + 1000000 AS record_idx, concat(' ', customer) AS customer, replace(amount, '.', ',.') AS amount, order_date, status, upper(priority) AS priority FROM messy WHERE record_idx % 10 = 0)"""
ITEMS = """items AS (SELECT doc_id, idx, line, CASE idx % 7 WHEN 3 THEN 'table' WHEN 5 THEN 'formula' WHEN 6 THEN 'code' ELSE 'text' END AS type
 FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS idx, unnest(string_split(text, chr(10))) AS line FROM documents))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text records with units, mixed date forms, blanks and padding."""
    return table(spark, sf_dir, "orders").selectExpr(*_select(MESSY_COLUMNS))


def _select(columns: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


def dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messy(spark, sf_dir)
    again = m.where("record_idx % 10 = 0").selectExpr("task_id", "record_idx + 1000000 AS record_idx", "concat(' ', customer) AS customer", "replace(amount, '.', ',.') AS amount", "order_date", "status", "upper(priority) AS priority")
    return m.unionByName(again)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as typed items: doc_id, idx, line, type."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    kind = F.expr("CASE idx % 7 WHEN 3 THEN 'table' WHEN 5 THEN 'formula' WHEN 6 THEN 'code' ELSE 'text' END")
    return d.select("doc_id", F.col("idx").cast("long").alias("idx"), "line", kind.alias("type"))
