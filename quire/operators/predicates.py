"""Filters: rule lists, conditional rows, date ranges and constraint sets, compiled on the driver to one Column."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import all_dates, blank_free, first_date
from .lookup import occurrences

_ORDER = {">": "__gt__", "<": "__lt__", ">=": "__ge__", "<=": "__le__"}


def _number(x: Column) -> Column:
    return F.trim(F.replace(x, F.lit(","))).try_cast("double")


def rule(name: str, op: str, value="", typed: bool = False, otherwise: bool = True) -> Column:
    """One rule; what can't be compared gives `otherwise`. typed: dates compare as dates."""
    cell = blank_free(F.col(name).cast("string"))
    if op in ("is_empty", "not_empty"):
        return (cell == "") if op == "is_empty" else (cell != "")
    if op in _ORDER:
        number = getattr(_number(cell), _ORDER[op])(F.try_to_number(F.lit(str(value).replace(",", "")), F.lit("S99999999999999999999.999999")).cast("double")) if _is_number(value) else F.lit(None).cast("boolean")
        if typed:
            number = F.coalesce(number, getattr(first_date(cell), _ORDER[op])(first_date(F.lit(str(value)))))
        return F.coalesce(number, F.lit(otherwise))
    text = str(value).strip()
    made = {"==": lambda: cell == text, "!=": lambda: cell != text, "contains": lambda: cell.contains(text), "startswith": lambda: cell.startswith(text), "endswith": lambda: cell.endswith(text)}
    return made[op]() if op in made else F.lit(otherwise)


def _is_number(value) -> bool:
    try:
        float(str(value).replace(",", ""))
    except ValueError:
        return False
    return True


def keep_rows(records: DataFrame, rules: list[tuple], typed: bool = False) -> DataFrame:
    """Rows that pass all rules; unparseable cells pass."""
    return records.where(reduce(and_, (rule(*r, typed=typed) for r in rules), F.lit(True)))


def matching_rows(records: DataFrame, condition: tuple, keep: bool = True) -> DataFrame:
    """Rows that meet a condition, or the others; unparseable cells don't meet it."""
    p = F.coalesce(rule(*condition, otherwise=False), F.lit(False))
    return records.where(p if keep else ~p)


def replace_text(records: DataFrame, columns: list[str], old: str, new: str, where: Column | None = None) -> DataFrame:
    """Replace in all text cells; _changed counts a row's affected cells."""
    hit = lambda k: F.coalesce(F.col(k).contains(old), F.lit(False)) & (F.lit(True) if where is None else where)
    changed = sum((hit(k).cast("int") for k in columns), F.lit(0)).alias("_changed")
    cells = [F.when(hit(k), F.replace(F.col(k), F.lit(old), F.lit(new))).otherwise(F.col(k)).alias(k) for k in columns]
    return records.select(*[x for x in records.columns if x not in columns], *cells, changed)


def delete_rows(records: DataFrame, columns: list[str], keyword: str) -> DataFrame:
    return records.where(~reduce(or_, (F.coalesce(F.col(k).contains(keyword), F.lit(False)) for k in columns)))


def date_range(text: Column) -> list[Column]:
    """lo and hi of the first two dates of an instruction, in order; null without two dates."""
    pattern = F.lit(r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}")
    found = F.filter(F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), first_date), lambda d: d.isNotNull())
    a, b = F.get(found, 0), F.get(found, 1)
    both = a.isNotNull() & b.isNotNull()
    return [F.when(both, F.least(a, b)).alias("lo"), F.when(both, F.greatest(a, b)).alias("hi")]


def in_date_range(records: DataFrame, column: str | None, lo: str, hi: str) -> DataFrame:
    """Rows whose date lies in the range; rows without a date go; without a date column all stay."""
    if column is None:
        return records
    d = first_date(F.col(column))
    return records.where(d.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def date_column(records: DataFrame, preferred: list[str]) -> str | None:
    """The first preferred column, else the first with any date; one pass over all columns."""
    for name in preferred:
        if name in records.columns:
            return name
    text = [n for n, t in records.dtypes if t == "string"]
    row = records.agg(*[F.max(first_date(F.col(n)).isNotNull().cast("int")).alias(n) for n in text]).first()
    return next((n for n in text if row[n]), None)


@dataclass
class Clause:
    """All of: a column hint's value holds any of the tokens; `window` is a pair of dates for date clauses."""

    tokens: dict[str, list[str]] = field(default_factory=dict)
    window: tuple[str, str] | None = None


def text_matches(text: Column, clause: Clause) -> Column:
    """Any token of each hint occurs in the text or is a date that the text has; dates lie in the window."""
    tests = []
    for values in clause.tokens.values():
        any_token = reduce(or_, (text.contains(v) for v in values))
        dates = F.array_compact(F.array(*[first_date(F.lit(v)) for v in values]))
        tests.append(any_token | F.arrays_overlap(all_dates(text), dates))
    if clause.window:
        lo, hi = (F.lit(x).cast("date") for x in clause.window)
        tests.append(F.exists(all_dates(text), lambda d: (d >= lo) & (d <= hi)))
    return F.coalesce(reduce(and_, tests), F.lit(False))


def any_clause(text: Column, clauses: list[Clause]) -> Column:
    return reduce(or_, (text_matches(text, c) for c in clauses), F.lit(False))


def with_neighbours(chunks: DataFrame, hit: Column, keys: list[str], order: list[str], structural: Column | None = None) -> DataFrame:
    """Chunks that hit and their neighbours; keys without a hit keep all, with degraded = true. Structural chunks stay."""
    near = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-1, 1)
    own = Window.partitionBy(*keys)
    c = chunks.withColumn("_hit", hit.cast("int"))
    c = c.withColumn("_near", F.max("_hit").over(near)).withColumn("degraded", F.max("_hit").over(own) == 0)
    stay = (F.col("_near") == 1) | F.col("degraded")
    return c.where(stay if structural is None else stay | structural).drop("_hit", "_near")


# Modes of a selection by dates and why one keeps all chunks.
IN_WINDOW, DEGRADED = "date_window", "date_window_degraded"
NO_DATES, NO_HIT = "no_parseable_ymd_in_text_chunks", "no_text_chunk_in_date_window"


def chunks_in_window(chunks: DataFrame, keys: list[str], order: list[str], text: str, structural: Column, lo: str, hi: str) -> DataFrame:
    """Chunks with a date of the window, their neighbours and structural chunks, with mode and reason. A task keeps all of its
    chunks, and the reason, where no text chunk has a date or none has one in the window."""
    near, own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-1, 1), Window.partitionBy(*keys)
    c = chunks.withColumn("_window_dates", F.when(structural, F.expr("CAST(array() AS array<date>)")).otherwise(all_dates(text)))
    first, last = (F.lit(x).cast("date") for x in (lo, hi))
    c = c.withColumn("_window_hit", F.exists("_window_dates", lambda d: (d >= first) & (d <= last)))
    c = c.withColumn("_window_any", F.bool_or(F.size("_window_dates") > 0).over(own)).withColumn("_window_some", F.bool_or("_window_hit").over(own)).withColumn("_window_near", F.bool_or("_window_hit").over(near))
    reason = F.when(~F.col("_window_any"), NO_DATES).when(~F.col("_window_some"), NO_HIT)
    c = c.withColumn("mode", F.when(reason.isNull(), IN_WINDOW).otherwise(DEGRADED)).withColumn("reason", reason)
    return c.where(F.col("reason").isNotNull() | F.col("_window_near") | structural).drop("_window_dates", "_window_hit", "_window_any", "_window_some", "_window_near")


def rows_in_scope(rows: DataFrame, clauses: list[Clause], columns: dict[str, list[str]], keys: list[str], order: str, most: int = 60) -> DataFrame:
    """Table rows that meet a constraint set in their candidate columns, else in their whole text; route tells which."""
    from ..functions.values import row_text

    def by_columns(c: Clause) -> Column:
        parts = [reduce(or_, (text_matches(blank_free(k), Clause({h: v})) for k in columns[h])) if columns.get(h) else F.lit(False) for h, v in c.tokens.items()]
        return reduce(and_, parts) if parts else F.lit(False)

    named = reduce(or_, (by_columns(c) for c in clauses))
    whole = any_clause(row_text([n for n in rows.columns if n not in keys]), clauses)
    r = rows.withColumn("route", F.when(named, "columns").when(whole, "row_text")).where("route IS NOT NULL")
    return r.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def holders(docs: DataFrame, values: DataFrame, value: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs x values: documents whose text holds a value's text, found by one pass over the texts."""
    found = occurrences(docs, values, value, text, key).select(key, value)
    return docs.join(found, key).join(values, value)


def holding_any(docs: DataFrame, clause: Clause, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents that hold a token of each of the clause's hints (dates and windows aside): one pass for all tokens of all hints,
    however many they are."""
    hints = [(v, h) for h, values in clause.tokens.items() for v in values]
    asked = docs.sparkSession.createDataFrame(hints, "_token string, _hint string")
    found = occurrences(docs, asked, "_token", text, key).join(asked, "_token").groupBy(key).agg(F.count_distinct("_hint").alias("_n"))
    return docs.join(found.where(F.col("_n") == len(clause.tokens)).select(key), key, "left_semi")
