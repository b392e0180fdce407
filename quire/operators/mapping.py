"""Schema and column mapping: the profile is small and known on the driver, so Catalyst sees plain projections."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import blank_free, is_blank
from .fuzzy import indel_ratio

_BRACKETS = r"[（(]([^）)]{1,10})[）)]"


def resolve(name: str, columns: list[str], aliases: dict[str, list[str]], fuzzy: float = 0.75) -> str | None:
    """The source column for a profile field: exact, alias, without unit, case-insensitive, containment, then fuzzy."""
    import re

    bare = lambda s: re.sub(_BRACKETS, "", s).strip().lower()
    for want in (name, *aliases.get(name, ())):
        if want in columns:
            return want
    for test in (lambda c, w: bare(c) == bare(w), lambda c, w: bare(w) in bare(c) or bare(c) in bare(w)):
        for want in (name, *aliases.get(name, ())):
            hit = next((c for c in columns if bare(c) and test(c, want)), None)
            if hit:
                return hit
    best = max(((indel_ratio(bare(c), bare(w)), -i, c) for i, c in enumerate(columns) for w in (name, *aliases.get(name, ()))), default=(0, 0, None))
    return best[2] if best[0] >= fuzzy else None


def to_profile(source: DataFrame, fields: list[str], aliases: dict[str, list[str]], keep: list[str] = (), drop_blank: bool = False) -> DataFrame:
    """Source columns under their profile names; unmapped ones go, missing ones are blank, all-blank rows can go."""
    found = {f: resolve(f, [c for c in source.columns if c not in keep], aliases) for f in fields}
    out = source.select(*keep, *[(blank_free(F.col(c).cast("string")) if c else F.lit("")).alias(f) for f, c in found.items()])
    return out.where(reduce(or_, (~is_blank(f) for f in fields))) if drop_blank else out


def header_types(headers: DataFrame, column: str) -> DataFrame:
    """Adds unit (from brackets) and type: % is a percentage, another unit a number, else by the name."""
    unit = F.regexp_extract(column, _BRACKETS, 1)
    kind = F.when(unit == "%", "percentage").when(unit != "", "number").when(F.contains(column, F.lit("date")), "date").otherwise("text")
    return headers.select(column, unit.alias("unit"), kind.alias("type"))


def leading_text(headers: DataFrame) -> DataFrame:
    """table_index, header of the leading text columns of each table: its dedup key."""
    stop = F.min(F.when(F.col("type") != "text", F.col("pos"))).over(Window.partitionBy("table_index"))
    return headers.withColumn("_stop", stop).where("_stop IS NULL OR pos < _stop").select("table_index", "header")


def same_columns(headers: DataFrame) -> DataFrame:
    a = headers.groupBy("table_index").agg(F.array_join(F.array_sort(F.collect_set("header")), ",").alias("s"))
    return a.agg((F.countDistinct("s") == 1).alias("same"))


def header_union(headers: DataFrame) -> DataFrame:
    """header, pos: all headers in first-seen order (one row for each header)."""
    first = headers.groupBy("header").agg(F.min("pos").alias("_p"))
    return first.select("header", F.row_number().over(Window.orderBy("_p", "header")).cast("long").alias("pos"))


# Names that stand for a hint's columns, and parts of names of date columns.
HINTS = {"city": ("城市", "市", "地区", "行政区划"), "monitor_time": ("监测时间", "时间", "日期"), "date": ("日期", "时间", "监测时间")}
DATE_WORDS = ("日期", "时间", "时刻", "监测时间", "统计日期", "date", "time")


def candidate_columns(columns: list[str], hint: str, aliases: dict[str, list[str]]) -> list[str]:
    """Columns that a hint may mean: those named so, by alias too; for a date's hint else those whose names hold a date word."""
    canonical = {a: name for name, others in aliases.items() for a in others}
    wanted = {hint.strip(), *HINTS.get(hint.strip(), ()), canonical.get(hint.strip(), "")} - {""}
    names = [c for c in dict.fromkeys(columns) if c.strip()]
    found = [c for c in names if c.strip() in wanted or canonical.get(c.strip()) in wanted]
    if found or not wanted & set(DATE_WORDS):
        return found
    return [c for c in names if any(w in c.lower() for w in DATE_WORDS)]


def with_date_column(records: DataFrame, has_range: bool, name: str = "date", signals: tuple[str, ...] = DATE_WORDS) -> DataFrame:
    """A blank date column for records that have none, where the instruction names a range of dates."""
    dated = any(w in c.lower() for c in records.columns for w in signals)
    return records.withColumn(name, F.lit("")) if has_range and not dated else records


def bundle_records(tables: list[DataFrame], fields: list[str], specs: list[dict], aliases: dict[str, list[str]], keep: list[str] = ()) -> DataFrame:
    """All tables of a bundle under the profile's columns, and under those that target tables filter by or fix."""
    helpers = [n for s in specs for n in (s.get("filter_field") or "", *(s.get("fixed_values") or {}))]
    wanted = [*fields, *(n for n in dict.fromkeys(x.strip() for x in helpers) if n and n not in fields)]
    return reduce(lambda a, b: a.unionByName(b), (to_profile(t, wanted, aliases, keep, drop_blank=True) for t in tables))
