"""Records: dedup, merges, gaps, order and assignment to target tables. record_idx carries the order; blank keys never
enter a shuffle key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import blank_free, filled_cells, is_blank, key_loose, key_strict
from .lookup import occurrences


def _first(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def exact_dedup(records: DataFrame, columns: list[str], order: str = "record_idx", within: list[str] = ()) -> DataFrame:
    """The first of equal records."""
    return _first(records, [*within, *columns], order)


def normalised_dedup(records: DataFrame, columns: list[str], order: str = "record_idx", within: list[str] = ()) -> DataFrame:
    """The first of records that are equal without units, commas and spaces."""
    return _first(records, [*within, *[key_strict(F.coalesce(F.col(k), F.lit(""))) for k in columns]], order)


def keyed_dedup(records: DataFrame, keys: list[str], columns: list[str], order: str = "record_idx", within: list[str] = ()) -> DataFrame:
    """The first of equal loose keys; where all keys are blank, the whole record is the key."""
    key = F.to_json(F.array(*[key_loose(k) for k in keys]))
    whole = F.to_json(F.array(*[key_loose(k) for k in columns]))
    blank = F.concat(*[key_loose(k) for k in keys]) == ""
    return _first(records, [*within, F.when(blank, F.concat(F.lit("R:"), whole)).otherwise(F.concat(F.lit("K:"), key))], order)


def choose_keys(records: DataFrame, preferred: list[str], candidates: list[list[str]] = ()) -> list[str]:
    """Preferred columns if all have data, else the first such candidate, else the three shortest names with data."""
    names = [k for k in records.columns if not k.startswith("_")]
    row = records.agg(*[F.max((key_loose(F.col(k).cast("string")) != "").cast("int")).alias(k) for k in names]).first()
    full = [k for k in names if row[k]]
    for keys in (preferred, *candidates):
        if keys and all(k in full for k in keys):
            return list(keys)
    return sorted(full, key=lambda k: (len(k), k))[:3]


def merge_by_key(records: DataFrame, keys: list[str], columns: list[str], strategy: str = "non_empty_wins", order: str = "record_idx", within: list[str] = ()) -> DataFrame:
    """One record a key in first-seen order, with merge_count; records without any key follow unmerged.

    non_empty_wins and longer_wins take each column's longest value, the earliest of these; latest_wins the last non-blank.
    """
    k = [F.trim(F.coalesce(F.col(x), F.lit(""))).alias(f"_k{i}") for i, x in enumerate(keys)]
    r = records.withColumns({f"_k{i}": x for i, x in enumerate(k)})
    blank = F.concat(*[F.col(f"_k{i}") for i in range(len(keys))]) == ""
    pick = {
        "latest_wins": lambda x: F.coalesce(F.max_by(x, F.when(is_blank(x), None).otherwise(F.col(order))), F.max_by(x, order)),
        "first_wins": lambda x: F.coalesce(F.min_by(x, F.when(is_blank(x), None).otherwise(F.col(order))), F.min_by(x, order)),
    }.get(strategy, lambda x: F.max_by(x, F.struct(F.length(blank_free(x)), -F.col(order))))
    merged = r.where(~blank).groupBy(*within, *[f"_k{i}" for i in range(len(keys))]).agg(*[pick(x).alias(x) for x in columns], F.min(order).alias(order), F.count("*").alias("merge_count"), F.lit(0).alias("unkeyed"))
    rest = r.where(blank).select(*within, *columns, order, F.lit(1).cast("long").alias("merge_count"), F.lit(1).alias("unkeyed"))
    return merged.select(*within, *columns, order, "merge_count", "unkeyed").unionByName(rest)


def detect_keys(records: DataFrame, columns: list[str], order: str = "record_idx", sample: int = 100) -> DataFrame:
    """field, score of up to five key-like columns, judged on the first records."""
    head = records.orderBy(order).limit(sample)
    long = head.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.lit(i).alias("pos"), F.col(k).cast("string").alias("v")) for i, k in enumerate(columns)])).alias("x")).select("x.*")
    a = long.where("v <> ''").groupBy("field", "pos").agg((F.countDistinct("v") / F.count("*")).alias("u"), F.avg(F.length("v")).alias("n"), F.bool_and(F.translate("v", ".-", "").rlike(r"^\d+$")).alias("numeric"))
    named = F.lower("field").rlike("id|序号|编号|排名|index|no|number|code")
    score = F.when(F.col("u") > 0.9, 3).when(F.col("u") > 0.7, 2).when(F.col("u") > 0.5, 1).otherwise(0) + 2 * F.col("numeric").cast("int") + (F.col("n") < 20).cast("int") + 2 * named.cast("int")
    return a.select("field", "pos", score.alias("score")).where("score >= 3").orderBy(F.desc("score"), "pos").limit(5).select("field", "score")


def first_values(records: DataFrame, columns: list[str], within: list[str], order: str = "record_idx") -> DataFrame:
    """For each group the first non-blank value of each column."""
    return records.groupBy(*within).agg(*[F.min_by(k, F.when(is_blank(k), None).otherwise(F.col(order))).alias(k) for k in columns])


def never_filled(records: DataFrame, columns: list[str]) -> DataFrame:
    """field: columns without any value."""
    a = records.agg(*[F.coalesce(F.max((~is_blank(k)).cast("int")), F.lit(0)).alias(k) for k in columns])
    return a.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("full")) for k in columns])).alias("x")).where("x.full = 0").select("x.field")


def carry_forward(records: DataFrame, columns: list[str], within: list[str], order: str = "record_idx") -> DataFrame:
    """Blank cells take the value above them; _filled counts a row's filled cells."""
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    new = {k: F.coalesce(F.last(F.nullif(blank_free(k), F.lit("")), ignorenulls=True).over(w), F.lit("")) for k in columns}
    r = records.withColumns({f"_new_{k}": v for k, v in new.items()})
    filled = sum((((blank_free(k) == "") & (F.col(f"_new_{k}") != "")).cast("int") for k in columns), F.lit(0))
    return r.withColumn("_filled", filled).select(*[F.col(f"_new_{k}").alias(k) if k in columns else F.col(k) for k in records.columns], "_filled")


def dominant_values(records: DataFrame, columns: list[str], within: list[str], least_rows: int = 4, fill: float = 0.4, share: float = 0.85) -> DataFrame:
    """within, field, value of text columns in which one value dominates enough to fill the gaps."""
    long = records.select(*within, F.explode(F.array(*[F.struct(F.lit(k).alias("field"), blank_free(k).alias("v")) for k in columns])).alias("x")).select(*within, "x.*")
    n = long.groupBy(*within, "field", "v").count()
    top = F.max(F.when(F.col("v") != "", F.struct("count", F.col("v"))))
    a = n.groupBy(*within, "field").agg(F.sum("count").alias("rows"), F.coalesce(F.sum(F.when(F.col("v") != "", F.col("count"))), F.lit(0)).alias("full"), top.alias("top"))
    good = (F.col("rows") >= least_rows) & (F.col("full") / F.col("rows") >= fill) & (F.col("top.count") / F.col("full") >= share) & (F.col("full") < F.col("rows"))
    return a.where(good).select(*within, "field", F.col("top.v").alias("value"))


def numeric_like(records: DataFrame, columns: list[str], least: int = 3, share: float = 0.7) -> DataFrame:
    """field, n, share of columns whose values are mostly numbers with at most a short unit."""
    long = records.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), blank_free(k).alias("v")) for k in columns])).alias("x")).select("x.*").where("v <> ''")
    hit = F.col("v").rlike(r"^[-+]?\d[\d,]*(?:\.\d+)?\s*[^\d\s]{0,8}$").cast("int")
    return long.groupBy("field").agg(F.count("*").alias("n"), F.avg(hit).alias("share")).where((F.col("n") >= least) & (F.col("share") >= share))


def reading_order(records: DataFrame, docs: DataFrame, value: str, within: list[str], order: str = "record_idx") -> DataFrame:
    """Adds position: where the record's key first occurs in its own document, and rank by it; unknown ones last. One pass over the
    texts finds all keys, so that no text is carried along with records."""
    (key,) = within
    found = occurrences(docs, records, value, key=key).select(F.col(key).alias("_found_key"), F.col(value).alias("_found_value"), F.col("position").alias("_found_at"))
    r = records.join(found, (F.col(key) == F.col("_found_key")) & (F.col(value) == F.col("_found_value")), "left")
    r = r.withColumn("position", F.coalesce(F.col("_found_at").cast("long"), F.lit(10**18))).drop("_found_key", "_found_value", "_found_at")
    return r.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy("position", order)))


def assign(records: DataFrame, specs: DataFrame, field: str = "filter_field", order: str = "record_idx") -> DataFrame:
    """records x table_index: specs (one row a target table; small by nature) whose filter value the record's column holds;
    a spec without a filter takes all if it is the first. Fixed values overwrite, capacity caps."""
    columns = records.columns
    cell = F.create_map(*[x for k in columns for x in (F.lit(k), F.col(k).cast("string"))])
    on = F.coalesce(F.contains(F.try_element_at(cell, F.col(field)), F.col("filter_value")), F.lit(False)) | ((F.coalesce("filter_value", F.lit("")) == "") & (F.col("table_index") == 0))
    r = records.join(F.broadcast(specs), on)
    fixed = lambda k: F.coalesce(F.nullif(F.trim(F.try_element_at("fixed_values", F.lit(k))), F.lit("")), F.col(k).cast("string")).alias(k)
    return r.select("table_index", "max_rows", *[fixed(k) if dict(records.dtypes)[k] == "string" else F.col(k) for k in columns])


def cap_rows(assigned: DataFrame, order: str = "record_idx") -> DataFrame:
    """The first rows of each table that has a capacity; tables without one aren't ranked."""
    n = F.row_number().over(Window.partitionBy("table_index").orderBy(order))
    capped = assigned.where("max_rows > 0").withColumn("_n", n).where("_n <= max_rows").drop("_n")
    return capped.unionByName(assigned.where("max_rows <= 0 OR max_rows IS NULL"))


def weak_groups(assigned: DataFrame, columns: list[str]) -> DataFrame:
    """table_index, weak: true where no row has more than one filled cell."""
    return assigned.groupBy("table_index").agg((F.max(filled_cells(columns)) <= 1).alias("weak"))


def fill_from_pool(assigned: DataFrame, pool: DataFrame, columns: list[str]) -> DataFrame:
    """Blank cells take the pool's value of their table; others stay."""
    p = pool.select("table_index", *[F.col(k).alias(f"_p_{k}") for k in columns])
    r = assigned.join(p, "table_index", "left")
    cells = [F.when(is_blank(k), F.coalesce(F.col(f"_p_{k}"), F.lit(""))).otherwise(F.col(k)).alias(k) if k in columns else F.col(k) for k in assigned.columns]
    return r.select(*cells)


def choose_source(model: DataFrame, tables: DataFrame, within: list[str]) -> DataFrame:
    """The table rows of a task where the model gave nothing, or at most one row against more than max(20, 10 x that)."""
    counts = model.groupBy(*within).agg(F.count("*").alias("m")).join(tables.groupBy(*within).agg(F.count("*").alias("t")), within, "full")
    m, t = F.coalesce("m", F.lit(0)), F.coalesce("t", F.lit(0))
    choice = F.when((t > 0) & ((m == 0) | ((m <= 1) & (t > F.greatest(F.lit(20), 10 * m)))), "table").otherwise("model")
    chosen = counts.select(*within, choice.alias("source"))
    both = model.withColumn("source", F.lit("model")).unionByName(tables.withColumn("source", F.lit("table")), allowMissingColumns=True)
    return both.join(chosen, [*within, "source"])


def missing_cells(records: DataFrame, required: list[str], keys: list[str]) -> DataFrame:
    """keys, field for every blank required cell."""
    blanks = F.filter(F.array(*[F.struct(F.lit(k).alias("field"), is_blank(k).alias("blank")) for k in required]), lambda x: x["blank"])
    return records.select(*keys, F.explode(blanks).alias("x")).select(*keys, "x.field")


def reconcile(model: DataFrame, tables: DataFrame, headers: DataFrame, within: list[str]) -> DataFrame:
    """Records of tasks with several target tables. Where all targets have the same columns and the model gave one record at
    most, the records of the source tables take its place. headers: within, table_index, header. Adds source."""
    same = headers.groupBy(*within, "table_index").agg(F.array_join(F.array_sort(F.collect_set("header")), "\x01").alias("_s"))
    same = same.groupBy(*within).agg((F.countDistinct("_s") == 1).alias("_same"))
    count = lambda df, name: df.groupBy(*within).agg(F.count("*").alias(name))
    c = same.join(count(model, "_m"), within, "left").join(count(tables, "_t"), within, "left")
    use = F.when(F.col("_same") & (F.coalesce("_m", F.lit(0)) <= 1) & (F.coalesce("_t", F.lit(0)) > 0), "table").otherwise("model")
    both = model.withColumn("source", F.lit("model")).unionByName(tables.withColumn("source", F.lit("table")))
    return both.join(c.select(*within, use.alias("source")), [*within, "source"])
