"""The library's functions for SQL users: `register(spark)` makes them temporary functions of a session.

Table functions, whose output each call's arguments determine (`analyze`):

- `sentence_windows(text, size, overlap)`: start, end, text. `FROM documents, LATERAL sentence_windows(text, 500, 80)`
- `expand_spans(TABLE(cells), 'table_idx')`: the key, r, c, text; one group for each table, in reading order.

Scalar functions in SQL, which the optimiser sees through: `latin_tokens(text)`, `is_blank(text)`, `type_boost(type)`,
`bm25_part(times, weight, tf, length, mean_length)`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class SentenceWindows:
    """A null text has no windows."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        numbers = [500 if size is None else size.value, 80 if overlap is None else overlap.value]
        if text.isTable or not isinstance(text.dataType, StringType):
            raise ValueError("sentence_windows: the first argument is a text")
        if not all(isinstance(x, int) for x in numbers) or not 0 <= numbers[1] < numbers[0] // 2:
            raise ValueError("sentence_windows: size and overlap are whole constants, and overlap is less than half of size")
        return AnalyzeResult(StructType().add("start", IntegerType()).add("end", IntegerType()).add("text", StringType()))

    def eval(self, text, size=500, overlap=80):
        from quire.operators.chunks import window_places

        for a, b in window_places(text or "", size, overlap):
            yield a, b, text[a:b]


class ExpandSpans:
    """One table's cells at a time, in order; columns: the key, r, pos, text, row_span, col_span, n_cols. The call itself asks for
    PARTITION BY the key and ORDER BY r, pos."""

    NEEDED = ("r", "pos", "text", "row_span", "col_span", "n_cols")

    def __init__(self):
        self.cells, self.cols, self.table = [], 0, None

    @staticmethod
    def analyze(cells: AnalyzeArgument, key: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not cells.isTable:
            raise ValueError("expand_spans: the first argument is a table, TABLE(...)")
        key = "table_idx" if key is None else key.value
        missing = [c for c in (key, *ExpandSpans.NEEDED) if c not in cells.dataType.names]
        if missing:
            raise ValueError(f"expand_spans: the table has no {', '.join(missing)}")
        schema = StructType().add(key, cells.dataType[key].dataType).add("r", IntegerType()).add("c", IntegerType()).add("text", StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn("r"), OrderingColumn("pos")])

    def eval(self, row, key="table_idx"):
        self.table = row[key]
        self.cells.append((int(row["r"]), row["text"], int(row["row_span"]), int(row["col_span"])))
        self.cols = max(self.cols, int(row["n_cols"]))

    def terminate(self):
        from quire.operators.layout import spread

        for (r, c), text in spread(self.cells, max((x[0] for x in self.cells), default=-1) + 1, self.cols).items():
            yield self.table, r, c, text


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    from ..operators.retrieval import B, BOOST, K1
    from ..session import ready

    ready(spark)
    for name, kind in (("sentence_windows", SentenceWindows), ("expand_spans", ExpandSpans)):
        spark.udtf.register(name, udtf(kind))
    boosts = " ".join(f"WHEN '{k}' THEN {v}D" for k, v in BOOST.items())
    for head, body in (
        ("latin_tokens(x STRING) RETURNS ARRAY<STRING>", "regexp_extract_all(lower(x), '[a-z0-9]+', 0)"),
        ("is_blank(x STRING) RETURNS BOOLEAN", "trim(coalesce(x, '')) = ''"),
        ("type_boost(kind STRING) RETURNS DOUBLE", f"CASE kind {boosts} ELSE 1.0D END"),
        ("bm25_part(times DOUBLE, weight DOUBLE, tf DOUBLE, length DOUBLE, mean_length DOUBLE) RETURNS DOUBLE", f"times * weight * tf * {K1 + 1}D / (tf + {K1}D * ({1 - B}D + {B}D * length / mean_length))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
