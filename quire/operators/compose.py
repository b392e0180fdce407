"""Whole stages as one call each: merging chunk results, filling target tables, post-processing by a profile, extraction.

Each is a plan over the record operators; nothing is collected but the names of detected key columns (five at most). record_idx
carries the order of records, `within` their task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from . import infer, mapping, quality
from . import predicates as E
from . import records as R
from .fuzzy import fuzzy_merge


@dataclass
class Profile:
    """What a target table asks for. fields: name to kind (text, number, money, percentage, date, phone ...); aliases: name to the
    source's names; keys: columns that make records equal; date_range: first and last day, with the column they hold for (None:
    the first one with dates); backfill: text columns that a dominant value fills; rules: see predicates.keep_rows; required:
    fields whose blanks are counted."""

    fields: dict[str, str]
    aliases: dict[str, list[str]] = field(default_factory=dict)
    keys: list[str] = field(default_factory=list)
    date_range: tuple[str, str] | None = None
    date_column: str | None = None
    backfill: list[str] = field(default_factory=list)
    rules: list[tuple] = field(default_factory=list)
    required: list[str] = field(default_factory=list)


def merge_records(records: DataFrame, columns: list[str], keys: list[str] | None = None, least: float = 0.98, order: str = "record_idx", strategy: str = "non_empty_wins") -> DataFrame:
    """columns, record_idx, merge_count: records of equal keys as one. Without keys they are detected, and what the keys leave is
    merged by similarity as well (merge_count then counts what the keys left); given keys, an empty list too, rule out both. Columns
    that begin with `_` go."""
    columns = [c for c in columns if not c.startswith("_")]
    given = keys is not None
    if not given:
        keys = [r.field for r in R.detect_keys(records, columns, order).collect()]  # five at most
    merged = records.select(*columns, order).withColumn("merge_count", F.lit(1).cast("long"))
    if keys:
        merged = R.merge_by_key(records, keys, columns, strategy, order).select(*columns, order, "merge_count")
    if given:
        return merged
    return fuzzy_merge(merged.drop("merge_count"), columns, least, order).select(*columns, order, "merge_count")


def merge_chunk_results(records: DataFrame, columns: list[str], keys: list[str] | None = None, order: str = "record_idx") -> tuple[DataFrame, DataFrame]:
    """(merged records, statistics): total, merged, reduction and the keys, detected over all chunks unless given."""
    keys = [r.field for r in R.detect_keys(records, columns, order).collect()] if keys is None else keys
    merged = merge_records(records, columns, keys, order=order)
    stats = merged.agg(F.coalesce(F.sum("merge_count"), F.lit(0)).cast("long").alias("total"), F.count("*").alias("merged"))
    reduction = F.when(F.col("total") > 0, 1 - F.col("merged") / F.col("total")).otherwise(0.0)
    return merged, stats.withColumn("reduction", reduction).withColumn("keys", F.array(*[F.lit(k) for k in keys]).cast("array<string>"))


def union_merge(tables: DataFrame, model: DataFrame, keys: list[str], columns: list[str], order: str = "record_idx") -> DataFrame:
    """Records of tables and of a model as one table: merged by key, the first value stays; columns that one side lacks and cells
    that none has are empty texts; equal records once."""
    both = tables.unionByName(model, allowMissingColumns=True)
    both = both.withColumns({k: F.trim(F.col(k)) for k in keys})
    merged = R.merge_by_key(both, keys, columns, "first_wins", order)
    return R.exact_dedup(merged.na.fill(""), columns, order)


def assigned(records: DataFrame, specs: DataFrame, keys: list[str], columns: list[str], groups: DataFrame | None = None) -> DataFrame:
    """table_index, max_rows and records for each target table: assigned by its filter with its fixed values, deduplicated, and no
    more than it holds. `groups` (table_index, records), where given, stand as they are built and only the rest is done."""
    a = R.assign(records, specs) if groups is None else groups.join(F.broadcast(specs.select("table_index", "max_rows")), "table_index")
    return R.cap_rows(R.keyed_dedup(a, keys, columns, within=["table_index"]))


def _fixed(rows: DataFrame, specs: DataFrame, columns: list[str]) -> DataFrame:
    """Fixed values of a row's table over its own; blank ones don't count. specs: a row for each target table, few by nature."""
    r = rows.join(F.broadcast(specs.select("table_index", "fixed_values")), "table_index")
    value = lambda k: F.coalesce(F.nullif(F.trim(F.try_element_at("fixed_values", F.lit(k))), F.lit("")), F.col(k))
    return r.select(*[value(k).alias(k) if k in columns else F.col(k) for k in rows.columns])


def _matches(source: DataFrame, specs: DataFrame, unfiltered: bool) -> DataFrame:
    """table_index and the source's records that a table's filter holds; without a filter all, or none."""
    named = F.coalesce("filter_field", F.lit("")) != ""
    cell = F.create_map(*[x for k in source.columns for x in (F.lit(k), F.col(k).cast("string"))])
    holds = named & (F.coalesce("filter_value", F.lit("")) != "") & F.coalesce(F.contains(F.try_element_at(cell, F.col("filter_field")), F.col("filter_value")), F.lit(False))
    on = holds | ~named if unfiltered else holds
    s = specs.select("table_index", "filter_field", "filter_value")
    return source.join(F.broadcast(s), on).select("table_index", *source.columns)


def _weak(groups: DataFrame, specs: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each target table: rows (has some), weak (none or no row with more than one filled cell), found (the source has
    some)."""
    weak = R.weak_groups(groups, columns).withColumn("rows", F.lit(True))
    has = found.select("table_index").distinct().withColumn("found", F.lit(True))
    t = specs.join(weak, "table_index", "left").join(has, "table_index", "left")
    return t.withColumns({"weak": F.coalesce("weak", F.lit(True)), "rows": F.coalesce("rows", F.lit(False)), "found": F.coalesce("found", F.lit(False))})


def replace_weak(groups: DataFrame, specs: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """table_index and columns, record_idx: groups without rows, or without a row of more than one filled cell, are replaced by the
    source's records that the table's filter holds; a group with such records takes the fixed values; one without records on
    either side gets a row of its fixed values, record_idx -1. Other groups stay."""
    keep = ["table_index", *columns, "record_idx"]
    found = _matches(source, specs, unfiltered=False)
    t = _weak(groups, specs, found, columns)
    flags = F.broadcast(t.select("table_index", "weak", "rows", "found"))  # a row for each target table
    stay = groups.select(*keep).join(flags, "table_index")
    other = groups.select(*keep).join(F.broadcast(specs.select("table_index")), "table_index", "left_anti")
    new = found.select(*keep).join(flags, "table_index").where("weak").select(*keep)
    old = stay.where("found AND NOT weak").select(*keep)
    blank = t.where(~F.col("rows") & ~F.col("found") & (F.size(F.map_filter("fixed_values", lambda _, v: F.trim(v) != "")) > 0))
    blank = blank.select("table_index", *[F.lit("").alias(k) for k in columns], F.lit(-1).cast("long").alias("record_idx"))
    return _fixed(new.unionByName(old).unionByName(blank), specs, columns).unionByName(stay.where("NOT found").select(*keep)).unionByName(other)


def fill_groups(groups: DataFrame, specs: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """table_index and columns, record_idx: weak groups are replaced by the source's records that the table's filter holds (all of
    them without a filter); in others blank cells take the first non-blank value of those records, and filled cells stay."""
    keep = ["table_index", *columns, "record_idx"]
    found = _matches(source, specs, unfiltered=True)
    flags = F.broadcast(_weak(groups, specs, found, columns).select("table_index", "weak", "found"))
    new = found.select(*keep).join(flags, "table_index").where("weak").select(*keep)
    old = groups.select(*keep).join(flags, "table_index", "left").where("NOT coalesce(weak AND found, false)").select(*keep)
    return new.unionByName(R.fill_from_pool(old, R.first_values(found, columns, ["table_index"]), columns).select(*keep))


def postprocess(records: DataFrame, profile: Profile, within: list[str], texts: DataFrame | None = None, order: str = "record_idx") -> tuple[DataFrame, DataFrame]:
    """(records, summary). Columns are mapped to the profile's, values brought to their kinds, equal records reduced to the first,
    the date range kept, gaps filled by dominant values, records ranked as their first key occurs in their task's text (`texts`:
    within, text), and the rules applied, in this order. summary: within, records, distinct, in_range, kept, backfilled."""
    keep = [*within, order]
    r = mapping.to_profile(records, list(profile.fields), profile.aliases, keep=keep)
    r = r.select(*keep, *[V.by_type(k, kind).alias(k) for k, kind in profile.fields.items()])
    names = list(profile.fields)
    once = R.keyed_dedup(r, profile.keys, names, order) if profile.keys else R.normalised_dedup(r, names, order)
    some = once
    if profile.date_range:
        column = profile.date_column or E.date_column(once, [k for k, kind in profile.fields.items() if kind == "date"])
        some = E.in_date_range(once, column, *profile.date_range)
    full = some.withColumn("_backfilled", F.lit(0))
    if profile.backfill:
        best = R.dominant_values(some, profile.backfill, within).groupBy(*within).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_best"))  # a field once
        full = some.join(best, within, "left")
        filled = {k: F.when(V.is_blank(k), F.coalesce(F.try_element_at("_best", F.lit(k)), F.col(k))).otherwise(F.col(k)) for k in profile.backfill}
        full = full.withColumn("_backfilled", sum(((V.is_blank(k) & F.try_element_at("_best", F.lit(k)).isNotNull()).cast("int") for k in profile.backfill), F.lit(0)))
        full = full.withColumns(filled).drop("_best")
    if texts is not None:
        key = F.coalesce(*[F.nullif(F.trim(F.col(k)), F.lit("")) for k in profile.keys or names], F.lit(""))
        full = R.reading_order(full.withColumn("_key", key), texts, "_key", within, order).drop("_key")
    out = E.keep_rows(full, profile.rules) if profile.rules else full
    counts = [(r, "records"), (once, "distinct"), (some, "in_range")]
    summary = out.groupBy(*within).agg(F.count("*").alias("kept"), F.sum("_backfilled").cast("long").alias("backfilled"))
    for df, name in reversed(counts):
        summary = df.groupBy(*within).agg(F.count("*").alias(name)).join(summary, within, "left")
    summary = summary.select(*within, *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("records", "distinct", "in_range", "kept", "backfilled")])
    return out.drop("_backfilled"), summary


def run_summary(records: DataFrame, within: list[str], required: list[str], texts: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """within, records, chars (of the task's texts), missing (blank required cells), retried (records with such a cell), seconds
    (of the task's calls: within, seconds): a row for each task with texts."""
    blanks = [V.is_blank(k).cast("long") for k in required]
    count = sum(blanks, F.lit(0).cast("long"))
    a = records.groupBy(*within).agg(F.count("*").alias("records"), F.sum(count).alias("missing"), F.count_if(count > 0).alias("retried"))
    t = texts.groupBy(*within).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("chars"))
    out = t.join(a, within, "left")
    out = out.join(calls.groupBy(*within).agg(F.sum("seconds").alias("seconds")), within, "left") if calls is not None else out.withColumn("seconds", F.lit(None).cast("double"))
    return out.select(*within, *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("records", "chars", "missing", "retried")], F.coalesce("seconds", F.lit(0.0)).alias("seconds"))


def extract(chunks: DataFrame, profile: Profile | None = None, extractor: Callable[[DataFrame], DataFrame] = infer.rule_records, hit: Column | None = None, calls: DataFrame | None = None) -> dict[str, DataFrame]:
    """records, rejects, audit and summary of chunks (doc_id, chunk_idx, text). `hit` narrows them to the chunks it holds for and
    their neighbours. extractor gives doc_id, chunk_idx, pos, field, value.

    With a profile, a chunk's fields of its names (or their aliases, in any case) are one record, post-processed; rejects are the
    chunks that give none, with reason; audit says for each cell whether it is kept, changed, filled or empty. Without one,
    records are the distinct fields and values of a document, and there is no audit."""
    used = E.with_neighbours(chunks, hit, ["doc_id"], ["chunk_idx"]).drop("degraded") if hit is not None else chunks
    pairs = extractor(used.select("doc_id", "chunk_idx", "text"))
    keys = ["doc_id", "chunk_idx"]
    if profile is None:
        r = pairs.withColumn("record_idx", F.struct("chunk_idx", "pos"))
        r = R.normalised_dedup(r, ["field", "value"], within=["doc_id"]).drop("record_idx")
        rejects = used.join(pairs.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("no field").alias("reason"))
        return {"records": r, "rejects": rejects, "summary": run_summary(r, ["doc_id"], [], used, calls)}
    named = F.lower(F.trim("field"))
    first = {k: F.min_by("value", F.when(named.isin(*{n.lower() for n in (k, *profile.aliases.get(k, []))}), F.col("pos"))) for k in profile.fields}
    raw = pairs.groupBy(*keys).agg(*[F.coalesce(v, F.lit("")).alias(k) for k, v in first.items()])
    good = ~F.forall(F.array(*[F.col(k) for k in profile.fields]), lambda x: F.trim(x) == "")
    raw = raw.where(good).withColumn("record_idx", F.col("doc_id") * F.lit(2**20) + F.col("chunk_idx"))
    final, counts = postprocess(raw.drop("chunk_idx"), profile, ["doc_id"])
    none = used.join(pairs.select(*keys).distinct().withColumn("_any", F.lit(True)), keys, "left").join(raw.select(*keys), keys, "left_anti")
    rejects = none.select(*keys, F.when(F.col("_any"), "no field of the profile").otherwise("no field").alias("reason"))
    audit = quality.cell_audit(raw.select("record_idx", *profile.fields), final.select("record_idx", *profile.fields), list(profile.fields))
    summary = run_summary(final, ["doc_id"], profile.required, used, calls).join(counts.drop("kept").withColumnRenamed("records", "extracted"), "doc_id", "left").na.fill(0)
    return {"records": final, "rejects": rejects, "audit": audit, "summary": summary}
